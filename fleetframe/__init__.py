"""Fleet configuration, inventory, compliance and status analytics on Spark.

Every operator takes and returns DataFrames and takes column names as
parameters.  Sub-packages:

* ``sources``   – readers/parsers for configuration, property, log, step,
  process, fact and stanza formats (S1–S12)
* ``sinks``     – site-XML, properties and partitioned writers (K1–K3)
* ``functions`` – column-level helpers (P4–P6, P9, P14, scalar parsing)
* ``operators`` – predicates, rules, joins, aggregates, ordered scans and
  set operations (P1–P16, J1–J10, A1–A9, W1–W8, O1–O3, U1–U4)
* ``plans``     – composed flows (site properties, service status, install
  summary) and the checks registered for the driver tables
* ``streaming`` – Structured Streaming monitors (T1–T7)
"""

__version__ = "0.1.0"
