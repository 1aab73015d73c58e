"""Write the physical plans (operator trees) of the hot-path stages to PLANS.md.

Usage: ``python tools/dump_plans.py [sf_dir]``. Plans are taken from
``explain("formatted")`` and trimmed to the operator tree plus scan schemas.
"""

from __future__ import annotations

import io
import os
import re
import sys
import tempfile
from contextlib import redirect_stdout

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def tree(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    lines = buf.getvalue().splitlines()
    out = []
    for line in lines:
        if line.startswith("(1)"):
            break
        if line.strip():
            out.append(line.rstrip())
    schemas = [ln.strip() for ln in lines if ln.strip().startswith(("ReadSchema", "PushedFilters"))]
    return "\n".join(out + [""] + schemas)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from pyspark.sql import functions as F
    from corpus_select.session import get_spark
    from corpus_select.operators import embedding as EM
    from corpus_select.operators import ngram_model as NG
    from corpus_select.operators import quality as QU
    from corpus_select.operators import select as SEL
    from corpus_select.operators.features import ngram_features
    from corpus_select.sources.io import materialize, read_table
    spark = get_spark()
    docs = read_table(spark, sf, "documents", "doc_id")
    work = tempfile.mkdtemp(prefix="run-plans-", dir="/tmp")
    feats = materialize(ngram_features(docs), os.path.join(work, "features"))
    tid = read_table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")
    model = NG.fit_subset_targets(feats, {"target": tid}, num_tokens_to_fit="all")
    model.table = model.table.persist()
    weights = materialize(NG.log_weights(feats, model), os.path.join(work, "weights"))
    emb = read_table(spark, sf, "embeddings", "vec_id").select(F.col("vec_id").alias("doc_id"), "embedding")
    stages = [
        ("features: tokenize + hash + sparse counts (narrow map; the Exchange is balance() spreading the one-row-group test file, absent on split inputs)", ngram_features(docs)),
        ("fit: raw and target bucket counts in one scan", NG.fit_subset_targets(feats, {"target": tid},
                                                                                num_tokens_to_fit="all").table),
        ("score: shipped bucket vector, one gather per document, no exchange", NG.log_weights(feats, model)),
        ("select: Gumbel top-k over stored weights", SEL.gumbel_top_k(weights, 333, seed=1)),
        ("fetch: chosen rows by semi join", SEL.semi_join(docs, SEL.gumbel_top_k(weights, 333, seed=1))),
        ("quality: chunk + stats + mask", QU.apply_quality_mask(QU.quality_stats(QU.chunk_documents(docs), "contents"))),
        ("mixture: log-density of every embedding (narrow map)", EM.score_samples(emb, EM.fit_by_label(
            read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")))),
    ]
    parts = ["# Physical plans of the hot path",
             "",
             f"Generated by `tools/dump_plans.py` on `{sf}` (local mode; AQE may still re-plan at run time).",
             ""]
    for title, df in stages:
        parts += [f"## {title}", "", "```", tree(df), "```", ""]
    text = "\n".join(parts)
    text = re.sub(r"#\d+L?", "", text)
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write(text)
    print("wrote PLANS.md")


if __name__ == "__main__":
    main()
