"""Recall of op10 against brute force: python tests/llm/recall_of_ann.py DIR (not collected by pytest)."""

import os
import sys
import tempfile

import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", ".."))
from gleanery.llm import ann  # noqa: E402

if __name__ == "__main__":
    folder = tempfile.mkdtemp(prefix="recall-")
    conf = {"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{folder}"}
    spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    rows = spark.read.parquet(f"{sys.argv[1]}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    found = ann.op10_ann_hnsw(spark, sys.argv[1]).toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), dtype=np.float64)
    hits = total = 0
    for q, own in found.groupby("query_id"):
        at = int(np.flatnonzero(ids == q)[0])
        score = x @ x[at]
        score[at] = -np.inf
        wanted = {ids[i] for i in np.lexsort((ids, -score))[: ann.K]}
        hits += len(wanted & set(own["vec_id"]))
        total += len(wanted)
    print(f"{len(ids)} vectors, {found['query_id'].nunique()} queries, recall at {ann.K}: {hits / total:.4f}")
