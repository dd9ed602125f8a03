"""Model store: the whole trained state in one versioned folder (S4-S10, M18,
M19).

``save`` writes every table and model of the state under ``v<n>-<id>`` and then
one manifest that names them with their schemas and the plain values (column
lists, features, which parts there are).  Only a version with a manifest
exists: a save that failed half-way is never loaded, and a version is never
changed.  ``load`` reads the manifest, compares each table's schema with it and
returns state whose tables are those files, so scoring a batch of one row reads
no training table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskloom.operators import anomaly, behavioral, device, explain, model, preprocess
from riskloom.operators import graph as gr
from riskloom.operators.isotonic import Isotonic
from riskloom.plans.train import Artifacts, NotFittedError, require
from riskloom.sources.message_log import _files

FORMAT = 1


class StoreError(RuntimeError):
    """A stored state that does not fit its manifest."""


def versions(base: str) -> list[str]:
    """Committed versions, oldest first."""
    from pyarrow import fs
    store, root = _files(base)
    if store.get_file_info(f"{root}/_manifests").type == fs.FileType.NotFound:
        return []
    return sorted(f.base_name[:-5] for f in store.get_file_info(fs.FileSelector(f"{root}/_manifests")) if f.base_name.endswith(".json"))


def _tables(art: Artifacts) -> dict[str, DataFrame]:
    out = {"encoders": art.prep.encoders, "medians": art.prep.medians, "cards": art.card_stats.table}
    e = art.entity_stats
    out |= {f"entity_{n}": t for n, t in (("device", e.device), ("email", e.email), ("addr", e.addr), ("card", e.card),
                                          ("high_risk", e.high_risk)) if t is not None}
    if art.graph is not None:
        out |= {"vertices": art.graph.vertices, "edges": art.graph.edges, "degrees": gr.degrees(art.graph)}
    out |= {n: t for n, t in (("node_features", art.node_features), ("embeddings", art.embeddings)) if t is not None}
    if art.classifier.calibrator is not None:
        out["calibrator"] = art.classifier.calibrator.knots
    return out


def save(spark: SparkSession, art: Artifacts, base: str) -> str:
    """Write the state as a new version and return its name."""
    require(art, "prep", "card_stats", "entity_stats", "classifier", "forest")
    version = f"v{len(versions(base)):06d}-{uuid.uuid4().hex[:8]}"
    path, schemas = f"{base}/{version}", {}
    for name, table in _tables(art).items():
        table.write.parquet(f"{path}/{name}")
        schemas[name] = json.loads(spark.read.parquet(f"{path}/{name}").schema.json())
    nodes = spark.createDataFrame(explain.tree_table(art.classifier))       # trees x nodes
    nodes.coalesce(1).write.parquet(f"{path}/tree_nodes")
    schemas["tree_nodes"] = json.loads(spark.read.parquet(f"{path}/tree_nodes").schema.json())
    art.classifier.model.write().save(f"{path}/gbt")
    anomaly.save(art.forest, spark, f"{path}/anomaly")
    manifest = {"format": FORMAT, "schemas": schemas, "features": art.features, "classifier_features": art.classifier.features,
                "cat_cols": art.prep.cat_cols, "num_cols": art.prep.num_cols, "stat_cols": art.card_stats.stat_cols}
    store, root = _files(base)
    store.create_dir(f"{root}/_manifests", recursive=True)
    with store.open_output_stream(f"{root}/_manifests/{version}.json") as f:
        f.write(json.dumps(manifest).encode())
    return version


def load(spark: SparkSession, base: str, version: str | None = None) -> Artifacts:
    """State of a version (default: the newest)."""
    there = versions(base)
    if not there or (version is not None and version not in there):
        raise NotFittedError(f"no stored state {version or ''} under {base}")
    version = version or there[-1]
    store, root = _files(base)
    with store.open_input_file(f"{root}/_manifests/{version}.json") as f:
        m = json.loads(f.read())
    if m["format"] != FORMAT:
        raise StoreError(f"format {m['format']} of {version}, expected {FORMAT}")
    tables: dict[str, DataFrame] = {}
    for name, wanted in m["schemas"].items():
        tables[name] = spark.read.parquet(f"{base}/{version}/{name}")
        if tables[name].schema != T.StructType.fromJson(wanted):
            raise StoreError(f"schema of {name} in {version} is not the manifest's")
    get = tables.get
    calibrator = Isotonic(tables["calibrator"], "raw_probability", "calibrated_probability") if "calibrator" in tables else None
    clf = model.Classifier(GBTClassificationModel.load(f"{base}/{version}/gbt"), calibrator, m["classifier_features"],
                           tables["tree_nodes"].toPandas())
    graph = None
    if "vertices" in tables:
        graph = gr.Graph(tables["vertices"], lambda: tables["edges"])
        graph.degree_table = tables["degrees"]
    return Artifacts(
        preprocess.Preprocessor(tables["encoders"], tables["medians"], m["cat_cols"], m["num_cols"]),
        behavioral.CardStats(tables["cards"], m["stat_cols"]),
        device.EntityStats(get("entity_device"), get("entity_email"), get("entity_addr"), get("entity_card"), get("entity_high_risk")),
        get("node_features"), graph, clf, anomaly.load(spark, f"{base}/{version}/anomaly"), m["features"], get("embeddings"))
