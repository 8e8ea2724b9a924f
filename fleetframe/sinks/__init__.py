"""Writers (K1–K3)."""

from fleetframe.sinks.writers import write_partitioned, write_properties, write_site_xml

__all__ = ["write_partitioned", "write_properties", "write_site_xml"]
