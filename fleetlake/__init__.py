"""fleetlake: device-telemetry analytics on Spark.

Modules (all DataFrame in, DataFrame out):

* ``session``    - session defaults and the shared folder (``spark.checkpoint.dir``)
* ``sources``    - table scans, connectors by source type, incremental reads and
                   watermark state, keyed messages, device documents
* ``sinks``      - keyed upsert (frame, keyed table, versioned table), file writers
* ``operators``  - predicates, projections, paging/top-k, joins, audit, quality,
                   roll-ups, bucket-split sequences and sessions, alerts
* ``functions``  - column functions (datetime text, ISO JSON, percent text, ...)
* ``plans``      - indicator contracts, stand-in views, layer tables and the
                   registered queries with their SQL equivalents
* ``streaming``  - micro-batch ingest, watermarked windows, per-batch upsert
"""

__version__ = "0.1.0"
