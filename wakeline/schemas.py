"""Tables of the dependency model and the constants that scores are built from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = (
    "name string, path string, namespace string, framework string, project_style string, output_type string, file_count long, "
    "type_declarations array<string>, object_refs array<string>, solutions array<string>, imports array<string>"
)
EDGES = "source string, target string, edge_type string, weight double, evidence array<string>, evidence_total long"
FILES = "path string, project string, text string"

REFERENCE, SHARED, CONFIG, REPORT, NAMESPACE, TYPE = "project_reference", "sproc_shared", "config_di", "rdl_sproc", "namespace_usage", "type_usage"
#: What one unit of an edge's weight counts in a node's coupling score; other types count nothing.
COUPLING = {REFERENCE: 1.0, SHARED: 0.8, CONFIG: 0.7, REPORT: 0.6, NAMESPACE: 0.5, TYPE: 0.3}
EVIDENCE_CAP = 10
#: Confidence of a consumer by its distance from the changed component.
CONFIDENCE = (1.0, 0.6, 0.3)
FAN_OUT_LIMIT, MOST_TARGETS, KEY_CONSUMERS = 50, 25, 10


def coupling_weight(edge_type: Column | str = "edge_type") -> Column:
    out = F.lit(0.0)
    for kind, w in COUPLING.items():
        out = F.when(F.col(edge_type) == kind if isinstance(edge_type, str) else edge_type == kind, w).otherwise(out)
    return out
