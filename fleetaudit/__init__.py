"""fleetaudit — dependency-risk analytics over many projects as Spark jobs.

Every operator takes and returns DataFrames keyed by ``project_id`` (or by
``(ecosystem, package)`` for per-package facts).  Nothing is collected to the
driver; the only driver-side loop is the hop loop of the graph closure.
"""

__all__ = ["session"]
