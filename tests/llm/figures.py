"""Held-out figures of the trained and the approximate operators: python -m tests.llm.figures FOLDER..."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import queries


def toxicity(spark: SparkSession, sf_dir: str) -> str:
    out = queries.op1_toxicity(spark, sf_dir).join(queries.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    n = {tuple(r[:2]): r[2] for r in out.where("held_out and toxic in (0, 1)").groupBy("toxic", "predicted").count().collect()}
    hit, miss, false, right = (n.get(k, 0) for k in ((1, 1), (1, 0), (0, 1), (0, 0)))
    return f"toxic found {hit} of {hit + miss}, clean flagged {false} of {false + right}"


def language(spark: SparkSession, sf_dir: str) -> str:
    out = queries.op9_language(spark, sf_dir).join(queries.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    right, n = out.where("held_out and lang is not null").agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    return f"languages right {right} of {n}"


def embeddings(spark: SparkSession, sf_dir: str) -> str:
    """Against all pairs, in blocks."""
    rows = queries.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where("embedding is not null").toPandas()
    x = np.stack(rows["embedding"].to_list()).astype(np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    links = sum(int((x[at : at + 1000] @ x.T >= 0.9).sum()) for at in range(0, len(x), 1000)) - len(x)
    found = queries.op8_embeddings(spark, sf_dir).agg(F.sum("n_links")).first()[0]
    return f"links found {found} of {links}"


def near(df: DataFrame) -> str:
    mine, other = df.agg(F.avg("near_edited"), F.avg("near_next")).first()
    return f"mean likeness to the edited text {mine:.3f}, to the next {other:.3f}"


def main(folders: list[str]) -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for folder in folders:
        for name, figure in (("op1", toxicity), ("op9", language), ("op8", embeddings), ("op2", lambda s, d: near(queries.op2_imatch(s, d)))):
            print(folder, name, figure(spark, folder), flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
