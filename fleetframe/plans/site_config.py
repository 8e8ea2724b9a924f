"""Site-property generation for many clusters at once.

Flow: parsed configuration -> last assignment wins (W6) -> one row per
cluster with the few values that matter -> service host lists with defaults
(P2-P4), host counts and lists (A1/A2), HA or single-node property rows per
service (A10) and the common properties: one array a cluster, exploded once.
The configuration is read once and shuffled by (cluster, key) and cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.functions.text import default_if_empty, norm_host
from fleetframe.operators.aggs import ordered_list
from fleetframe.sources.conf import last_wins

# Fixed values from the reference: which configuration key lists the hosts
# of each service, the services whose empty list means "every cluster host",
# the SCM client port, and the common properties with their source keys.
SERVICE_KEYS = {
    "om": "OM_HOSTS",
    "scm": "SCM_HOSTS",
    "datanode": "DATANODE_HOSTS",
    "recon": "RECON_HOSTS",
    "s3gateway": "S3GATEWAY_HOSTS",
    "httpfs": "HTTPFS_HOSTS",
}
ALL_HOSTS_SERVICES = ("datanode",)
CLUSTER_KEY = "CLUSTER_HOSTS"
SCM_CLIENT_PORT = 9860
OM_SERVICE_ID_KEY = "OZONE_OM_SERVICE_ID"
SCM_SERVICE_ID_KEY = "OZONE_SCM_SERVICE_ID"
COMMON_FROM_CONF = [
    ("ozone.scm.db.dirs", "OZONE_SCM_DB_DIRS", "SCM metadata storage directory"),
    ("ozone.scm.ha.ratis.storage.dir", "OZONE_SCM_HA_RATIS_STORAGE_DIR", "SCM Ratis storage directory"),
    ("ozone.metadata.dirs", "OZONE_SCM_METADATA_DIRS", "SCM metadata directory"),
    ("ozone.om.db.dirs", "OZONE_OM_DB_DIR", "OM metadata storage directory"),
    ("ozone.om.ratis.storage.dir", "OZONE_OM_RATIS_STORAGE_DIR", "OM Ratis storage directory"),
    ("ozone.recon.db.dir", "OZONE_RECON_DB_DIR", "Recon database directory"),
    ("ozone.recon.scm.db.dirs", "OZONE_RECON_SCM_DB_DIRS", "Recon SCM database directory"),
    ("ozone.recon.om.db.dir", "OZONE_RECON_OM_DB_DIR", "Recon OM database directory"),
    ("ozone.scm.datanode.id.dir", "OZONE_SCM_DATANODE_ID_DIR", "DataNode ID storage directory"),
    ("dfs.container.ratis.datanode.storage.dir", "DFS_CONTAINER_RATIS_DATANODE_STORAGE_DIR",
     "DataNode Ratis storage directory"),
    ("hdds.datanode.dir", "HDDS_DATANODE_DIR", "DataNode data storage directory"),
]
COMMON_FIXED = [
    ("ozone.enabled", "true", "Enable Ozone in the cluster"),
    ("ozone.security.enabled", "false", "Security is disabled for simplicity in this setup"),
]
CORE_SITE = [
    ("fs.defaultFS", "ofs://ozone1/", "The default filesystem URI"),
    ("fs.ofs.impl", "org.apache.hadoop.fs.ozone.OzoneFileSystem", None),
    ("fs.AbstractFileSystem.ofs.impl", "org.apache.hadoop.fs.ozone.OzFs", None),
]


def fill_placement(hosts: Column, cluster_hosts: Column, all_hosts: Column | bool) -> Column:
    """An empty service host list defaults to the first cluster host, or
    to every cluster host for services that run everywhere (DataNode)."""
    first = norm_host(F.split(cluster_hosts, ",").getItem(0))
    default = F.when(all_hosts if isinstance(all_hosts, Column) else F.lit(all_hosts),
                     cluster_hosts).otherwise(first)
    return default_if_empty(hosts, default)


def explode_list(df: DataFrame, col: str, sep: str = ",", pos: str = "pos",
                 out: str = "host", normalise: bool = True) -> DataFrame:
    """P3 list flatten keeping position (0-based); with ``normalise`` each
    element is cleaned like ``xargs`` (P4) and empty elements are dropped."""
    sep_re = "".join("\\" + ch if ch in ".^$|?*+()[]{}\\" else ch for ch in sep)
    e = df.select("*", F.posexplode(F.split(F.col(col), sep_re, -1)).alias(pos, out))
    if normalise:
        e = e.withColumn(out, norm_host(F.col(out))).where(F.col(out) != "")
    return e


def _settings(conf: DataFrame, source: str, keys: Sequence[str]) -> DataFrame:
    """``(source, _ff_v)``: the last values of ``keys`` in every source, as a
    map.  Other keys only show that the source is there; they fall together
    before the shuffle, and a map has at most ``len(keys)`` entries."""
    known = conf.select(source, F.when(F.col("key").isin(list(keys)), F.col("key")).alias("key"), "value", "line_no")
    pair = F.when(F.col("key").isNotNull() & F.col("value").isNotNull(), F.struct("key", "value"))
    return (last_wins(known, source=source).groupBy(source)
            .agg(F.map_from_entries(F.collect_list(pair)).alias("_ff_v")))


def _setting(key: str) -> Column:
    return F.try_element_at(F.col("_ff_v"), F.lit(key))


def _host_list(service: str) -> Column:
    """A service's comma list with its default."""
    return fill_placement(_setting(SERVICE_KEYS[service]), _setting(CLUSTER_KEY), service in ALL_HOSTS_SERVICES)


def _hosts(listed: Column) -> Column:
    """The hosts of a comma list, cleaned (P3, P4); empty ones go."""
    return F.filter(F.transform(F.split(F.coalesce(listed, F.lit("")), ",", -1), norm_host), lambda h: h != "")


def placement_from_conf(conf: DataFrame, source: str = "source") -> DataFrame:
    """Configuration rows ``(source, line_no, key, value)`` -> placement rows
    ``(source, service, pos, host)`` with P2 defaults applied."""
    lists = F.array(*[F.struct(F.lit(s).alias("service"), _host_list(s).alias("hosts")) for s in SERVICE_KEYS])
    placed = _settings(conf, source, [CLUSTER_KEY, *SERVICE_KEYS.values()]).select(source, F.explode(lists).alias("_ff_s"))
    return explode_list(placed.select(source, "_ff_s.service", "_ff_s.hosts"), "hosts").drop("hosts")


def _prop(name: Column | str, value: Column, description: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(name).alias("name"), value.alias("value"), lit(description).alias("description"))


def _group_rows(prefix: str, sid: Column, joined: Column, n: Column, single: str) -> Column:
    """The rows that a service has once: ids and node list if there are
    several hosts, else its name."""
    svc = prefix.split(".")[-1].upper()
    ha = F.array(_prop(f"{prefix}.service.ids", sid, f"{svc} service IDs"),
                 _prop(F.concat(F.lit(f"{prefix}.nodes."), sid), joined, F.concat(F.lit(f"{svc} nodes for service "), sid)))
    if single == "scm":
        one = F.array(_prop(f"{prefix}.names", joined, "The hostname or IP address of the Storage Container Manager"),
                      _prop(f"{prefix}.client.address", F.concat(joined, F.lit(f":{SCM_CLIENT_PORT}")),
                            "The address and port for the SCM client"))
    else:
        one = F.array(_prop(f"{prefix}.address", joined, "The hostname or IP address of the Ozone Manager"))
    return F.when(n > 1, ha).otherwise(one)


def _address(prefix: str, sid: Column, host: Column) -> Column:
    svc = prefix.split(".")[-1].upper()
    return _prop(F.concat(F.lit(f"{prefix}.address."), sid, F.lit("."), host), host,
                 F.concat(F.lit(f"{svc} address for "), host, F.lit(" in service "), sid))


def service_props(placement: DataFrame, keys: Sequence[str], prefix: str,
                  service_id: Column, single: str = "scm", pos: str = "pos",
                  host: str = "host") -> DataFrame:
    """A10 for one service kind: ``(keys, name, value, description)`` rows.

    HA (more than one host): ``<prefix>.service.ids``, ``<prefix>.nodes.<id>``
    with the hosts in configured order, and one ``<prefix>.address.<id>.<host>``
    per host.  Single host: for ``single="scm"`` ``<prefix>.names`` and
    ``<prefix>.client.address`` (host:9860); for ``single="om"``
    ``<prefix>.address``.

    Per group: one aggregate gives the host count and the ordered list (A1,
    A2 - sorted per chunk, so a huge group is not sorted in one task) and
    the group-level rows are one ``explode``.  The per-host address rows
    come straight from the placement rows joined to the HA groups, so no
    host array is ever gathered.
    """
    keys = list(keys)
    g = (ordered_list(placement, keys, pos, host, out="_ff_hosts", count_out="_ff_n")
         .withColumn("_ff_sid", service_id))
    sid = F.col("_ff_sid")
    rows = _group_rows(prefix, sid, F.col("_ff_hosts"), F.col("_ff_n"), single)
    group_rows = g.select(*keys, F.inline(rows))
    h = F.col(host).cast("string")
    ha = g.where(F.col("_ff_n") > 1).select(*[F.col(k).alias(f"_ff_g{i}") for i, k in enumerate(keys)], "_ff_sid")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & placement[k].eqNullSafe(ha[f"_ff_g{i}"])
    address_rows = placement.join(ha, same).select(*keys, F.inline(F.array(_address(prefix, sid, h))))
    return group_rows.unionByName(address_rows)


def site_properties(conf: DataFrame, source: str = "source") -> DataFrame:
    """Every property of the site file for every source configuration:
    ``(source, name, value, description)``.

    What a configuration leaves out is written empty: a service id, a host
    list without hosts, and each of the common properties has its row in
    every configuration.  One pass: a configuration's host lists are values
    of its own rows, so its properties are one array, made in a projection
    over one row and exploded.
    """
    keys = [CLUSTER_KEY, *(SERVICE_KEYS[s] for s in ("scm", "om", "recon")), OM_SERVICE_ID_KEY, SCM_SERVICE_ID_KEY,
            *(key for _, key, _ in COMMON_FROM_CONF)]
    setting = lambda key: F.coalesce(_setting(key), F.lit(""))
    # columns of their own: each is used several times below
    d = _settings(conf, source, keys).select(
        source, "_ff_v", setting(SCM_SERVICE_ID_KEY).alias("_ff_scm_id"), setting(OM_SERVICE_ID_KEY).alias("_ff_om_id"),
        _hosts(_host_list("scm")).alias("_ff_scm"), _hosts(_host_list("om")).alias("_ff_om"),
        norm_host(F.get(F.split(F.coalesce(_host_list("recon"), F.lit("")), ",", -1), 0)).alias("_ff_recon"))

    def service(name: str) -> list[Column]:
        prefix, hosts, sid = f"ozone.{name}", F.col(f"_ff_{name}"), F.col(f"_ff_{name}_id")
        each = F.transform(hosts, lambda h: _address(prefix, sid, h))
        return [_group_rows(prefix, sid, F.array_join(hosts, ","), F.size(hosts), name),
                F.when(F.size(hosts) > 1, each).otherwise(F.slice(each, 1, 0))]
    rest = F.array(
        _prop("ozone.recon.address", F.col("_ff_recon"), "The hostname or IP address of Recon"),
        *[_prop(name, setting(key), text) for name, key, text in COMMON_FROM_CONF],
        *[_prop(name, F.lit(value), text) for name, value, text in COMMON_FIXED])
    return d.select(source, F.inline(F.concat(*service("scm"), *service("om"), rest)))


def core_site_properties(conf: DataFrame, source: str = "source") -> DataFrame:
    """The rows of the core-site file, the same for every configuration."""
    rows = conf.sparkSession.createDataFrame(CORE_SITE, "name string, value string, description string")
    return conf.select(source).distinct().crossJoin(F.broadcast(rows))


__all__ = ["fill_placement", "explode_list", "placement_from_conf", "service_props",
           "site_properties", "core_site_properties", "SERVICE_KEYS"]

