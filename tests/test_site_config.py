"""Golden values of the reference's HA / single-node configuration tests."""

import os

from pyspark.sql import functions as F

from fleetframe.operators.windows import elect
from fleetframe.plans.site_config import placement_from_conf, site_properties
from fleetframe.sources.conf import read_conf

from tests.test_sources import MULTI_CONF

SINGLE_CONF = """CLUSTER_HOSTS="ozone"
OM_HOSTS="ozone"
SCM_HOSTS="ozone"
DATANODE_HOSTS="ozone"
RECON_HOSTS="ozone"
S3GATEWAY_HOSTS="ozone"
HTTPFS_HOSTS="ozone"
OZONE_OM_SERVICE_ID="ozone1"
OZONE_SCM_SERVICE_ID="cluster1"
OZONE_OM_DB_DIR="/var/lib/hadoop-ozone/om/data"
"""

DEFAULTS_CONF = """CLUSTER_HOSTS="h1, h2,h3"
OM_HOSTS=""
DATANODE_HOSTS=""
SCM_HOSTS="s1,s2"
"""

SPACE_CONF = 'CLUSTER_HOSTS="testhost1 testhost2"\nOM_HOSTS=""\n'


def _confs(spark, tmp_out, **texts):
    paths = []
    for name, text in texts.items():
        p = os.path.join(tmp_out, f"{name}.conf")
        with open(p, "w") as f:
            f.write(text)
        paths.append(p)
    return read_conf(spark, paths).withColumn(
        "source", F.regexp_extract("source", r"([a-z]+)\.conf$", 1))


def test_multi_and_single_properties(spark, tmp_out):
    c = _confs(spark, tmp_out, multi=MULTI_CONF, single=SINGLE_CONF)
    props = site_properties(c).collect()
    multi = {r["name"]: r["value"] for r in props if r["source"] == "multi"}
    single = {r["name"]: r["value"] for r in props if r["source"] == "single"}

    assert multi["ozone.om.service.ids"] == "ozone1"
    assert multi["ozone.om.nodes.ozone1"] == "om1,om2,om3"
    assert multi["ozone.scm.service.ids"] == "cluster1"
    assert multi["ozone.scm.nodes.cluster1"] == "scm1,scm2,scm3"
    for h in ("om1", "om2", "om3"):
        assert multi[f"ozone.om.address.ozone1.{h}"] == h
    for h in ("scm1", "scm2", "scm3"):
        assert multi[f"ozone.scm.address.cluster1.{h}"] == h
    assert "ozone.om.address" not in multi and "ozone.scm.names" not in multi
    assert multi["ozone.recon.address"] == "recon"

    assert single["ozone.om.address"] == "ozone"
    assert single["ozone.scm.names"] == "ozone"
    assert single["ozone.scm.client.address"] == "ozone:9860"
    assert single["ozone.recon.address"] == "ozone"
    assert "ozone.om.service.ids" not in single and "ozone.scm.service.ids" not in single
    assert single["ozone.om.db.dirs"] == "/var/lib/hadoop-ozone/om/data"
    assert single["ozone.enabled"] == "true" and single["ozone.security.enabled"] == "false"


def test_placement_defaults(spark, tmp_out):
    c = _confs(spark, tmp_out, defaults=DEFAULTS_CONF, space=SPACE_CONF)
    p = placement_from_conf(c).collect()
    get = lambda src, svc: [r["host"] for r in sorted(p, key=lambda r: r["pos"])
                            if r["source"] == src and r["service"] == svc]
    assert get("defaults", "om") == ["h1"]                      # empty -> first cluster host
    assert get("defaults", "datanode") == ["h1", "h2", "h3"]    # DataNode empty -> all
    assert get("defaults", "scm") == ["s1", "s2"]
    assert get("defaults", "recon") == ["h1"]                   # missing key -> first host
    # a space-separated list is one host after a comma split (xargs keeps one space)
    assert get("space", "om") == ["testhost1 testhost2"]


def test_election_goldens(spark):
    one = spark.createDataFrame([("c1", 0, "scm1")], "cluster string, pos int, host string")
    three = spark.createDataFrame([("c3", 0, "scm1"), ("c3", 1, "scm2"), ("c3", 2, "scm3")],
                                  "cluster string, pos int, host string")
    got1 = {r["host"]: r["command"] for r in elect(one, ["cluster"], "pos").collect()}
    got3 = {r["host"]: r["command"] for r in elect(three, ["cluster"], "pos").collect()}
    assert got1 == {"scm1": "--init"}
    assert got3 == {"scm1": "--init", "scm2": "--bootstrap", "scm3": "--bootstrap"}
