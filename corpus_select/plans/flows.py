"""End-to-end flows as user-level calls.

1. :func:`ngram_selection` - library flow: fit the hashed n-gram estimator,
   score every raw document, keep k (top-k or Gumbel sampling, one or
   several targets).
2. :func:`chunked_selection` - corpus flow: 128-word chunks -> quality
   statistics and mask -> domain exclusion -> score -> sample -> top-up ->
   fetch -> optional packing.
3. :func:`classifier_selection` - classifier baseline: labelled lines ->
   positional mix -> train / validation -> logistic model -> probabilities ->
   quality and domain filters -> top-k or Pareto retrieval -> top-up -> packing.
4. :func:`hybrid_selection` - n-gram weights blended with the weights of two
   mixtures fitted on raw and target embeddings -> length filter -> top-k or
   Gumbel sample, per target.

Intermediates that later stages read more than once (features, weights) are
written once under the session's shared checkpoint folder (``materialize``),
which also cuts lineage for recovery after executor loss.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import treebank_tokens
from ..operators import classifier as CL
from ..operators import embedding as EM
from ..operators import ngram_model as NG
from ..operators import pack as PK
from ..operators import quality as QU
from ..operators import select as SEL
from ..operators.features import ngram_features
from ..session import checkpoint_dir
from ..sources.io import cache_key, materialize


@dataclass
class Selection:
    model: NG.NgramModel
    weights: DataFrame
    chosen: DataFrame


def _work_dir(df: DataFrame, work_dir: str | None, prefix: str) -> str:
    return work_dir or os.path.join(checkpoint_dir(df.sparkSession), f"{prefix}_{uuid.uuid4().hex[:12]}")


def _fingerprint(df: DataFrame) -> str:
    """Rows and a sum of row hashes: names the input in stored intermediates that a later call may reuse."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}x{(int(r['h'] or 0)) % (1 << 64):016x}"


def _stored_as(tokenizer) -> str | None:
    """Name of a tokenizer in stored paths; a function without a name of its own is never reused."""
    if isinstance(tokenizer, str):
        return tokenizer
    name = getattr(tokenizer, "__qualname__", "")
    return None if not name or "<" in name else f"{tokenizer.__module__}.{name}"


def ngram_scores(raw: DataFrame, targets: DataFrame | dict[str, DataFrame] | None = None, *,
                 target_ids: DataFrame | dict[str, DataFrame] | None = None, n: int = 2,
                 num_buckets: int = 10000, tokenizer: str = "wordpunct", hash_fn: str = "sha256",
                 num_tokens_to_fit="all", target_laplace_smoothing: float = 0.0,
                 separate_targets: bool = False, target_proportions: Sequence[float] | None = None,
                 min_example_length: int | None = 100, work_dir: str | None = None,
                 reuse: bool = True, input_name: str | None = None) -> tuple[NG.NgramModel, DataFrame]:
    """Fit the n-gram estimator and score every raw document: (model, stored weights).

    ``input_name`` names ``raw`` in the folder names by which ``work_dir`` is used again; without one the
    rows are read once more to name them by their content.
    """
    raw = raw.select("doc_id", "text")
    work = _work_dir(raw, work_dir, "ngram")
    tok = _stored_as(tokenizer)
    again = reuse and work_dir is not None and tok is not None
    key = cache_key(n=n, b=num_buckets, tok=tok or uuid.uuid4().hex, h=hash_fn, input=(input_name or _fingerprint(raw)) if again else "new")
    feats = materialize(ngram_features(raw, n=n, num_buckets=num_buckets, tokenizer=tokenizer, hash_fn=hash_fn),
                        os.path.join(work, f"features_{key}"), overwrite=not again)
    common = dict(n=n, num_buckets=num_buckets, tokenizer=tokenizer, hash_fn=hash_fn,
                  num_tokens_to_fit=num_tokens_to_fit, target_laplace_smoothing=target_laplace_smoothing,
                  separate_targets=separate_targets, target_proportions=target_proportions)
    if target_ids is not None:
        ids = target_ids if isinstance(target_ids, dict) else {"target": target_ids}
        model = NG.fit_subset_targets(feats, ids, **common)
    else:
        tdict = targets if isinstance(targets, dict) else {"target": targets}
        tf = {name: ngram_features(tdf, n=n, num_buckets=num_buckets, tokenizer=tokenizer, hash_fn=hash_fn)
              for name, tdf in tdict.items()}
        if not separate_targets and len(tf) > 1:
            pooled = None
            for f in tf.values():
                pooled = f if pooled is None else pooled.unionByName(f)
            tf = {"target": pooled}
        model = NG.fit_from_features(feats, tf, **common)
    # the fitted table is B x T rows: keep it in memory for saving and scoring
    model.table = model.table.persist()
    weights = materialize(NG.log_weights(feats, model, min_example_length=min_example_length, n=n),
                          os.path.join(work, f"weights_{key}_min{min_example_length}"), overwrite=True)
    return model, weights


def _proportions(model: NG.NgramModel, target_proportions: Sequence[float] | None) -> Sequence[float]:
    if target_proportions is not None:
        return target_proportions
    shares = {r["target"]: r["proportion"] for r in model.proportions.collect()}
    return [shares[t] for t in model.targets]


def _choose(weights: DataFrame, k: int, model: NG.NgramModel, target_proportions, top_k: bool, seed: int) -> DataFrame:
    """k rows by ``weight_e10``: top-k or Gumbel sample, by quota where there are several targets."""
    if len(model.targets) > 1:
        return SEL.select_multi_target(weights, k, model.targets, _proportions(model, target_proportions), top_k_mode=top_k, seed=seed)
    return SEL.top_k(weights, k) if top_k else SEL.gumbel_top_k(weights, k, seed=seed)


def _matching(weights: DataFrame, raw: DataFrame, where: Column | None) -> DataFrame:
    """Weights of the documents whose own columns satisfy ``where`` (all, if there is none)."""
    return weights if where is None else weights.join(raw.where(where).select("doc_id"), "doc_id", "left_semi")


def ngram_selection(raw: DataFrame, targets: DataFrame | dict[str, DataFrame] | None, k: int, *,
                    target_proportions: Sequence[float] | None = None, top_k: bool = False, seed: int = 0,
                    where: Column | None = None, **fit) -> Selection:
    """Hashed n-gram importance selection of k raw documents.

    ``raw``: ``(doc_id, text, ...)``. ``targets``: a DataFrame of texts or a dict
    of them. When a target is a subset of the raw pool, pass its ids in
    ``target_ids`` instead: raw and target counts then come from one scan of
    the stored raw features (no second pass over any text). ``where`` is a
    filter over raw's own columns (the metadata hook); the other options are
    those of :func:`ngram_scores`.
    """
    model, weights = ngram_scores(raw, targets, target_proportions=target_proportions, **fit)
    weights = _matching(weights, raw, where)
    return Selection(model, weights, _choose(weights, k, model, target_proportions, top_k, seed))


def hybrid_selection(raw: DataFrame, targets: DataFrame | dict[str, DataFrame] | None, embeddings: DataFrame,
                     target_embeddings: DataFrame, k: int, *, alpha: float = 0.5, components: int = 1000,
                     target_components: int = 50, max_iter: int = 10, mixtures: tuple | None = None,
                     target_proportions: Sequence[float] | None = None, top_k: bool = False, seed: int = 0,
                     where: Column | None = None, require_all: bool = True, **fit) -> Selection:
    """Selection by n-gram and embedding weights together (blend ``alpha``).

    ``embeddings`` and ``target_embeddings``: ``(doc_id, embedding)`` of the raw
    pool and of the target. Both mixtures are fitted by EM unless given. Every
    scored document must have an embedding; ``require_all=False`` selects among
    those that have one instead. Output weights carry ``hybrid_weight`` and its
    integer form ``weight_e10``, which ranks.
    """
    model, weights = ngram_scores(raw, targets, target_proportions=target_proportions, **fit)
    if mixtures is None:
        mixtures = (EM.fit_gmm(embeddings, components, max_iter, seed=seed), EM.fit_gmm(target_embeddings, target_components, max_iter, seed=seed))
    gmm = EM.embedding_log_weight(embeddings, *mixtures)
    if require_all:
        # embeddings of documents that the length filter dropped are not asked for
        gmm = gmm.join(weights.select("doc_id").distinct(), "doc_id", "left_semi")
    blended = None
    for t in model.targets:
        exact = weights.where(F.col("target") == F.lit(t)).withColumn("exact", F.col("weight_e10") / F.lit(float(NG.E10)))
        part = EM.hybrid_weight(exact, gmm, alpha, ng_col="exact", strict=require_all).withColumn("target", F.lit(t))
        blended = part if blended is None else blended.unionByName(part)
    blended = blended.withColumn("weight_e10", NG.scaled(F.col("hybrid_weight")))
    work = _work_dir(raw, fit.get("work_dir"), "hybrid")
    blended = materialize(blended, os.path.join(work, "hybrid_weights"), overwrite=True)
    blended = _matching(blended, raw, where)
    return Selection(model, blended, _choose(blended, k, model, target_proportions, top_k, seed))


def chunked_selection(raw: DataFrame, target_ids: DataFrame, k: int, *, chunk_length: int = 128,
                      quality_filter: bool = True, exclude_domains: Sequence[str] = (),
                      topup: dict[str, int] | None = None, pack: bool = False, seed: int = 0,
                      n: int = 2, num_buckets: int = 10000, work_dir: str | None = None, input_name: str | None = None) -> DataFrame:
    """Chunk, filter by quality, score, sample k chunks, top up from held-out domains, fetch, pack.

    ``raw``: ``(doc_id, text, domain)``. ``target_ids``: ``doc_id`` of raw
    documents forming the target; their chunks are the target corpus.
    Output: ``chunk_id, contents, domain`` (domain a list; 2 entries when packed).
    """
    work = _work_dir(raw, work_dir, "chunked")
    key = cache_key(length=chunk_length, quality=quality_filter, exclude="-".join(sorted(exclude_domains)) or "none",
                    input=(input_name or _fingerprint(raw)) if work_dir is not None else "new").replace("/", "_")
    ch = QU.chunk_documents(raw, chunk_length, keep=("domain",))
    # both filters are row-local: they are columns of the one pass over the chunks
    good = QU.quality_stats(ch, "contents") if quality_filter else ch
    mask = QU.ST.quality_mask() if quality_filter else F.lit(True)
    if exclude_domains:
        mask = mask & (~F.col("domain").isin(list(exclude_domains)) | F.col("domain").isNull())
    ch = materialize(good.select("doc_id", "chunk_no", "domain", "contents", F.coalesce(mask, F.lit(False)).alias("eligible")), os.path.join(work, f"chunks_{key}"))
    # dense ids: documents' own ids may be of any size
    ids = SEL.dense_index(ch.select("doc_id", "chunk_no"), ["doc_id", "chunk_no"], "chunk_id")
    ch = materialize(ch.join(ids, ["doc_id", "chunk_no"]), os.path.join(work, f"numbered_{key}"))
    pool = ch.select(F.col("chunk_id").alias("doc_id"), F.col("contents").alias("text"))
    tgt = ch.join(target_ids.select("doc_id"), "doc_id", "left_semi").select(F.col("chunk_id").alias("doc_id"))
    _, weights = ngram_scores(pool, target_ids=tgt, n=n, num_buckets=num_buckets, min_example_length=None, work_dir=os.path.join(work, "ngram"),
                              reuse=work_dir is not None, input_name=key)
    eligible = ch.where("eligible").select(F.col("chunk_id").alias("doc_id"))
    chosen = SEL.gumbel_top_k(weights.join(eligible, "doc_id", "left_semi"), k, seed=seed).select("doc_id")
    if topup:
        held = ch.select(F.col("chunk_id").alias("doc_id"), "domain")
        chosen = SEL.union_ids(chosen, SEL.domain_topup(held, topup, seed=seed))
    rows = ch.join(chosen.withColumnRenamed("doc_id", "chunk_id"), "chunk_id", "left_semi") \
        .select("chunk_id", "contents", "domain")
    if pack:
        return PK.pack_pairs(rows, "chunk_id", "contents", "domain")
    return PK.as_unpacked(rows)


def corpus_flow(raw: DataFrame, target_ids: DataFrame, k: int, **options) -> DataFrame:
    """:func:`chunked_selection` with the fixed held-out domains of the n-gram corpus flow: excluded from scoring, topped up at random."""
    return chunked_selection(raw, target_ids, k, exclude_domains=list(SEL.NGRAM_FLOW_TOPUP), topup=dict(SEL.NGRAM_FLOW_TOPUP), **options)


def classifier_retrieval(pool: DataFrame, probs: DataFrame, k: int, *, mode: str = "pareto", seed: int = 0,
                         quality_filter: bool = False, exclude_domains: Sequence[str] = (),
                         topup: dict[str, int] | None = None, pack: bool = False) -> DataFrame:
    """Rows chosen by probability: quality mask and domain exclusion before, top-up and packing after.

    ``pool``: ``(doc_id, text, domain)``. Output ``doc_id, contents, domain, score``
    (domain a list, score null for topped-up rows; packed rows have no score). A pool
    of at most k rows after the filters is kept whole.
    """
    able = pool
    if exclude_domains:
        able = SEL.domain_exclude(able, list(exclude_domains))
    if quality_filter:
        able = QU.apply_quality_mask(QU.quality_stats(able.select("doc_id", "text"), "text"))
    scored = probs.join(able.select("doc_id"), "doc_id", "left_semi")
    chosen = CL.retrieve(scored, k, mode=mode, seed=seed).select("doc_id", F.col("prob").alias("score"))
    if topup:
        more = SEL.domain_topup(pool.select("doc_id", "domain"), topup, seed=seed).select("doc_id", F.lit(None).cast("double").alias("score"))
        chosen = chosen.unionByName(more).groupBy("doc_id").agg(F.max("score").alias("score"))
    rows = pool.select("doc_id", F.col("text").alias("contents"), "domain").join(chosen, "doc_id")
    if pack:
        return PK.pack_pairs(rows.drop("score"), "doc_id", "contents", "domain")
    return PK.as_unpacked(rows)


def classifier_selection(target: DataFrame, background: DataFrame, pool: DataFrame, k: int, *,
                         mode: str = "pareto", seed: int = 0, reg_params: Sequence[float] = (0.0, 0.01, 0.1),
                         num_features: int = 1 << 18, ngrams: int = 2, word_vectors: DataFrame | None = None,
                         work_dir: str | None = None, **retrieval):
    """Classifier baseline: lines -> mix -> train/val -> model -> probabilities -> retrieval.

    All three inputs are ``(doc_id, text)``. Returns ``(model, probs, chosen)``.
    With options of :func:`classifier_retrieval` (then the pool has a ``domain``), chosen
    are the fetched rows; without, ids and keys.
    """
    line = CL.classifier_line(F.lit(1), F.col("text"))  # the mix sets the labels
    mix = CL.zip_mix(target.select("doc_id", "text"), background.select("doc_id", "text"), ["doc_id"], ["doc_id"], line_col=line)
    # a line's words are its tokens: training and prediction see the same ones
    tokens = F.filter(F.split(F.regexp_replace(F.col("line"), r"^__label__\S+ ,( |$)", ""), " "), lambda t: t != "")
    rows = mix.select((F.col("pair") * 2 + F.col("label")).alias("doc_id"), "split", "label", tokens.alias("tokens"))
    work = _work_dir(pool, work_dir, "classifier")
    rows = materialize(rows, os.path.join(work, "lines"), overwrite=True)
    model = CL.train_classifier(rows.where("split = 'train'"), rows.where("split = 'val'"), reg_params=reg_params, num_features=num_features,
                                ngrams=ngrams, word_vectors=word_vectors, tokens_col="tokens")
    # retrieval reads the probabilities several times (round histogram, shuffle, take): store them once
    cut = pool.select("doc_id", treebank_tokens(F.col("text")).alias("tokens"))
    probs = materialize(CL.predict_proba(model, cut, word_vectors=word_vectors, tokens_col="tokens"), os.path.join(work, "probs"), overwrite=True)
    if retrieval:
        return model, probs, classifier_retrieval(pool, probs, k, mode=mode, seed=seed, **retrieval)
    return model, probs, CL.retrieve(probs, k, mode=mode, seed=seed)


def classifier_flow(target: DataFrame, background: DataFrame, pool: DataFrame, k: int, n_topup: int = 4_000_000, **options):
    """:func:`classifier_selection` with the quality mask and the fixed held-out domains of the classifier corpus flow."""
    return classifier_selection(target, background, pool, k, quality_filter=True, exclude_domains=SEL.CLASSIFIER_FLOW_DOMAINS,
                                topup=SEL.classifier_flow_topup(n_topup), **options)
