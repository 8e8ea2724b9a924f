"""Readers and parsers."""

from fleetframe.sources.blocks import compose_ports, parse_blocks, parse_dir_report, read_compose_ports
from fleetframe.sources.conf import last_wins, parse_conf, parse_os_release, read_conf
from fleetframe.sources.lines import read_lines, split_lines
from fleetframe.sources.properties import parse_properties, read_properties, resolve_refs
from fleetframe.sources.records import (parse_host_facts, parse_ps, parse_run_log, parse_step,
                                        parse_test_log)
from fleetframe.sources.xml import parse_property_xml, read_site_xml

__all__ = ["compose_ports", "parse_blocks", "parse_dir_report", "read_compose_ports", "last_wins",
           "parse_conf", "parse_os_release", "read_conf", "read_lines", "split_lines",
           "parse_properties", "read_properties", "resolve_refs", "parse_host_facts", "parse_ps",
           "parse_run_log", "parse_step", "parse_test_log", "parse_property_xml", "read_site_xml"]
