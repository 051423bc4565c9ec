"""Label-table operators: counts, priors, contracts, coverage, folds, key joins
(A1-A7, J1-J7, J14-J19, W2-W4, W7-W11, U1-U6).

Annotation frames are long ``(entity_id, term_id[, aspect])``; counts are
per-term aggregates (partial aggregation map-side, so a hot term costs one
row per map task before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annospark.functions import stats


# ---------------------------------------------------------------- counts
def term_counts(ann: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A1: annotation rows per term (``n``)."""
    by = by or ["term_id"]
    return ann.groupBy(*by).agg(F.count("*").alias("n"))


def term_priors(ann: DataFrame, ia: DataFrame, ia_default: float) -> DataFrame:
    """A2: ``prior = rows(term) / distinct entities``; IA left-joined, missing -> ``ia_default``."""
    n_ent = ann.agg(F.countDistinct("entity_id")).scalar()  # scalar subquery
    out = term_counts(ann).select("term_id", (F.col("n") / n_ent).alias("prior"))
    return join_ia(out, ia, ia_default)


def term_probabilities(ann: DataFrame) -> DataFrame:
    """A3: ``count(term) / total annotation rows``."""
    total = ann.agg(F.count("*")).scalar()  # scalar subquery, no global window
    return term_counts(ann).select("term_id", (F.col("n") / total).alias("prob"))


def aspect_summary(ann: DataFrame, top_n: int) -> DataFrame:
    """A4: per aspect distinct terms, annotations, max / upper-median / min term
    frequency and how many of its terms are in the global top-N (count desc, term asc)."""
    c = ann.groupBy("aspect", "term_id").agg(F.count("*").alias("n"))
    top = global_top_k(c.groupBy("term_id").agg(F.sum("n").alias("n")), top_n)
    c = c.join(top.select("term_id", F.lit(1).alias("in_top")), "term_id", "left")
    base = c.groupBy("aspect").agg(
        F.count("*").alias("unique_terms"), F.sum("n").alias("annotations"),
        F.max("n").alias("max_freq"), F.min("n").alias("min_freq"),
        F.count("in_top").alias("terms_in_top"))
    med = stats.upper_median(c, "n", ["aspect"], out="median_freq")
    return base.join(med, "aspect")


def labels_per_entity(ann: DataFrame, entities: DataFrame, cap: int = 10) -> DataFrame:
    """A5: distinct labels per entity incl. zero-label entities, ``strat_bin = min(n, cap)``."""
    n = ann.groupBy("entity_id").agg(F.countDistinct("term_id").alias("n_labels"))
    e = entities.select("entity_id").distinct().join(n, "entity_id", "left")
    e = e.withColumn("n_labels", F.coalesce("n_labels", F.lit(0)).cast("long"))
    return e.withColumn("strat_bin", F.least(F.col("n_labels"), F.lit(cap)).cast("int"))


def label_matrix(ann: DataFrame, contract: DataFrame) -> DataFrame:
    """Long form of the binary label matrix re-indexed to contract columns."""
    c = contract.select("term_id", "col_idx")
    return ann.select("entity_id", "term_id").distinct().join(c, "term_id") \
        .select("entity_id", "col_idx")


def sparsity_profile(labels: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """Nnz, density, mean labels per entity / entities per label, exact
    p50 / p90 / p99 / max of both per-row and per-column counts."""
    lab = labels.select("entity_id", "term_id").distinct()
    rows = lab.groupBy("entity_id").agg(F.count("*").alias("v")).withColumn("axis", F.lit("row"))
    cols = lab.groupBy("term_id").agg(F.count("*").alias("v")).withColumn("axis", F.lit("col"))
    both = rows.select("axis", "v").unionByName(cols.select("axis", "v"))
    q = stats.exact_quantiles(both, "v", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, by=["axis"])
    agg = both.groupBy("axis").agg(F.count("*").alias("n_keys"), F.sum("v").alias("nnz"),
                                   F.max("v").alias("max"), F.avg("v").alias("mean"))
    out = agg.join(q, "axis")
    if n_rows and n_cols:
        out = out.withColumn("density", F.col("nnz") / F.lit(float(n_rows) * float(n_cols)))
    return out


def density_by_aspect(labels: DataFrame, entities: DataFrame) -> DataFrame:
    """A7 per aspect: terms, distinct labels (``nnz``) and the share of filled cells of entities x terms.  Each label is
    counted once by term first, so nothing is counted distinct under a hot aspect."""
    per = labels.select("aspect", "term_id", "entity_id").distinct().groupBy("aspect", "term_id").agg(F.count("*").alias("n"))
    n_entities = entities.select("entity_id").distinct().agg(F.count("*")).scalar()
    return per.groupBy("aspect").agg(F.count("*").alias("n_terms"), F.sum("n").alias("nnz")).select(
        "aspect", "n_terms", "nnz", (F.col("nnz") / (F.col("n_terms") * n_entities)).alias("density"))


# ---------------------------------------------------------------- top-k / contracts
def global_top_k(counts: DataFrame, k: int, n: str = "n") -> DataFrame:
    """The k most frequent terms (count desc, term asc)."""
    return counts.orderBy(F.col(n).desc(), F.col("term_id")).limit(k)


def top_k_per_aspect(counts: DataFrame, k_by_aspect: dict[str, int | None]) -> DataFrame:
    """Label contract.  Per aspect the k most frequent terms (count desc,
    term asc), blocks concatenated in the dict's order with contiguous
    ``col_idx``; a term in several blocks keeps its first position.

    The input is the per-term count table (one row per ontology term, tens of
    thousands of rows whatever the annotation volume).  The rank filter uses
    the literal maximum k, so Spark keeps only the top rows per aspect in each
    map task (WindowGroupLimit) before the per-aspect window.  ``None`` for k
    keeps all terms of the aspect."""
    order = F.create_map(*[x for i, a in enumerate(k_by_aspect) for x in (F.lit(a), F.lit(i))])
    limits = {a: int(k) for a, k in k_by_aspect.items() if k is not None}
    c = counts.filter(F.col("aspect").isin(list(k_by_aspect)))
    w = Window.partitionBy("aspect").orderBy(F.col("n").desc(), F.col("term_id"))
    c = c.withColumn("rn", F.row_number().over(w))
    if limits:
        if len(limits) == len(k_by_aspect):
            c = c.filter(F.col("rn") <= max(limits.values()))
        ks = F.create_map(*[x for a, k in limits.items() for x in (F.lit(a), F.lit(k))])
        c = c.filter(F.coalesce(F.col("rn") <= F.element_at(ks, F.col("aspect")), F.lit(True)))
    c = c.withColumn("blk", F.element_at(order, F.col("aspect")))
    # a term kept by several aspects stays in its first block only
    first = Window.partitionBy("term_id").orderBy("blk", "rn")
    c = c.withColumn("_d", F.row_number().over(first)).filter(F.col("_d") == 1)
    c = c.withColumn("rk", F.row_number().over(Window.partitionBy("blk").orderBy("rn")))
    sizes = c.groupBy("blk").agg(F.count("*").alias("sz"))
    sizes = sizes.withColumn("off", F.coalesce(F.sum("sz").over(
        Window.partitionBy(F.lit(0)).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.join(F.broadcast(sizes.select("blk", "off")), "blk")  # one row per aspect
    return c.select("term_id", "aspect", "n", (F.col("off") + F.col("rk") - 1).cast("int").alias("col_idx"))


def elite_contract(counts: DataFrame, contract: DataFrame, noise_floor: int,
                   aspect_order: list[str]) -> DataFrame:
    """Terms with ``n >= noise_floor`` inside the contract, ordered per aspect
    (count desc, term asc) and blocks in ``aspect_order``, contiguous ``col_idx``."""
    c = counts.filter(F.col("n") >= noise_floor).join(contract.select("term_id"), "term_id", "left_semi")
    return top_k_per_aspect(c, dict.fromkeys(aspect_order))


def coverage_by_rank(counts: DataFrame, ia: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """W7/W8 building block: terms ranked by count desc (term asc) with the
    cumulative annotation share and (optionally) cumulative IA share."""
    by = by or ["aspect"]
    c = counts
    if ia is not None:
        c = c.join(ia.select("term_id", "ia"), "term_id", "left").fillna(0.0, subset=["ia"])
    else:
        c = c.withColumn("ia", F.lit(0.0))
    c = c.withColumn("iamass", F.col("ia") * F.col("n"))
    c = stats.group_positions(c, by, [F.col("n").desc(), F.col("term_id")], out="rank0",
                              sums={"_cn": F.col("n").cast("double"), "_ci": F.col("iamass")})
    tot = c.groupBy(*by).agg(F.sum("n").alias("_tn"), F.sum("iamass").alias("_ti"))
    c = c.join(tot, by)
    return c.select(*by, "term_id", "n", "ia", (F.col("rank0") + 1).alias("rank"),
                    ((F.col("_cn") + F.col("n")) / F.col("_tn")).alias("cum_share"),
                    ((F.col("_ci") + F.col("iamass")) / F.col("_ti")).alias("cum_ia_share"))


def coverage_ranks(counts: DataFrame, ia: DataFrame, floor: int, shares: tuple[float, ...] = (0.95, 0.99),
                   by: list[str] | None = None) -> DataFrame:
    """Terms with ``n >= floor`` are eligible, ranked by count desc (term
    asc).  Per group: all terms, eligible terms (``k_noise``), the first rank at
    which the eligible terms' cumulative IA reaches each share (``k_95`` ...; 0
    without eligible IA), the counts at rank ``k_noise`` and the next, and the
    eligible IA as a fraction of all terms' IA and of itself (infinite when
    that total is 0)."""
    by = by or ["aspect"]
    c = counts.join(ia.select("term_id", "ia"), "term_id", "left").fillna(0.0, subset=["ia"])
    ok = F.col("n") >= floor
    per = c.groupBy(*by).agg(
        F.count("*").alias("n_terms"), F.count_if(ok).alias("k_noise"),
        F.coalesce(F.min(F.when(ok, F.col("n"))), F.lit(0)).alias("count_at_k"),
        F.coalesce(F.max(F.when(~ok, F.col("n"))), F.lit(0)).alias("count_at_k_plus_1"),
        F.coalesce(F.sum(F.when(ok, F.col("ia"))), F.lit(0.0)).alias("_eligible"), F.sum("ia").alias("_all"))
    r = stats.group_positions(c.filter(ok), by, [F.col("n").desc(), F.col("term_id")], out="rank0",
                              sums={"_ci": F.col("ia")})
    reached = (F.col("_ci") + F.col("ia")) / F.col("_eligible")
    names = [f"k_{round(100 * s)}" for s in shares]
    ks = r.join(per.select(*by, "_eligible"), by).filter(F.col("_eligible") > 0).groupBy(*by).agg(
        *[F.min(F.when(reached >= s - 1e-12, F.col("rank0") + 1)).alias(k) for s, k in zip(shares, names)])
    inf = F.lit(float("inf"))
    return per.join(ks, by, "left").select(
        *by, "n_terms", "k_noise", *[F.coalesce(k, F.lit(0)).alias(k) for k in names], "count_at_k", "count_at_k_plus_1",
        F.when(F.col("_all") > 0, F.col("_eligible") / F.col("_all")).otherwise(inf).alias("ia_fraction_of_all"),
        F.when(F.col("_eligible") > 0, F.lit(1.0)).otherwise(inf).alias("ia_fraction_of_eligible"))


def annotation_coverage(counts: DataFrame, top_k: int, target: float = 0.99,
                        by: list[str] | None = None) -> DataFrame:
    """Share of annotations covered by the top-K terms, the smallest count
    included at K, and the number of terms needed to reach ``target``."""
    by = by or ["aspect"]
    r = coverage_by_rank(counts, by=by)
    return r.groupBy(*by).agg(
        F.max(F.when(F.col("rank") <= top_k, F.col("cum_share"))).alias("share_at_k"),
        F.min(F.when(F.col("rank") <= top_k, F.col("n"))).alias("min_count_at_k"),
        F.min(F.when(F.col("cum_share") >= target - 1e-12, F.col("rank"))).alias("k_for_target"),
        F.count("*").alias("n_terms"))


# ---------------------------------------------------------------- folds / samples
def _drawn(id_col: str, seed: int):
    """A reproducible random order of ids: hex MD5 of ``id:seed``, which other engines give as well."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def stratified_kfold(entities: DataFrame, n_folds: int, seed: int, bin_col: str | None = "strat_bin",
                     id_col: str = "entity_id") -> DataFrame:
    """Balanced deterministic folds.  Inside each stratum rows are
    ordered by the MD5 of id and seed and dealt round-robin, so fold sizes
    per stratum differ by at most one.  Not numpy's permutation."""
    by = [bin_col] if bin_col else []
    df = entities.withColumn("_h", _drawn(id_col, seed))
    if not by:
        df = df.withColumn("_g", F.lit(0))
        by = ["_g"]
    pos = stats.group_positions(df, by, ["_h", id_col], out="_pos")
    out = pos.withColumn("fold", (F.col("_pos") % n_folds).cast("int")).drop("_h", "_pos")
    return out.drop("_g") if "_g" in out.columns else out


def even_row_sample(df: DataFrame, n: int, order_col: str = "row_idx") -> DataFrame:
    """P10: rows at positions ``floor(i*(N-1)/(m-1))``, m = min(N, n), of the ``order_col`` order."""
    d = df.withColumn("_g", F.lit(0))
    d = stats.group_positions(d, ["_g"], [order_col], out="_pos").drop("_g")
    total = df.count()
    m = min(total, n)
    if m <= 1:
        return d.filter(F.col("_pos") == 0).drop("_pos")
    # position p is picked iff some i has floor(i*(N-1)/(m-1)) == p; with
    # N-1 >= m-1 each i gives a distinct p, so test i = ceil(p*(m-1)/(N-1)).
    i = F.ceil(F.col("_pos") * F.lit(m - 1) / F.lit(total - 1))
    hit = F.floor(i * F.lit(total - 1) / F.lit(m - 1)) == F.col("_pos")
    return d.filter(hit).drop("_pos")


def holdout_split(entities: DataFrame, frac: float, seed: int, id_col: str = "entity_id") -> DataFrame:
    """Deterministic split by hash of the distinct entity (``is_holdout``)."""
    h = F.conv(F.substring(_drawn(id_col, seed), 1, 8), 16, 10).cast("long") / F.lit(2.0 ** 32)
    return entities.select(id_col).distinct().withColumn("is_holdout", h < F.lit(frac))


# ---------------------------------------------------------------- joins
def join_ia(terms: DataFrame, ia: DataFrame, default: float, uniform: bool = False) -> DataFrame:
    """Left join of IA weights; a term without weight gets ``default`` (required).
    With ``uniform`` all terms weigh 1 where the weights sum to nothing, which would
    make every weighted metric 0."""
    j = terms.join(ia.select("term_id", F.col("ia").alias("_ia")), "term_id", "left") \
        .withColumn("ia", F.coalesce(F.col("_ia"), F.lit(float(default)))).drop("_ia")
    if uniform:
        total = j.agg(F.coalesce(F.sum("ia"), F.lit(0.0)).alias("s")).scalar()
        j = j.withColumn("ia", F.when(total > 0, F.col("ia")).otherwise(F.lit(1.0)))
    return j


def attach_aspect(ann: DataFrame, terms: DataFrame, unknown: str = "UNK") -> DataFrame:
    """Aspect from the ontology term table; unknown terms -> ``unknown``."""
    t = terms.select("term_id", F.col("aspect").alias("_asp"))
    return ann.drop("aspect").join(t, "term_id", "left") \
        .withColumn("aspect", F.coalesce(F.col("_asp"), F.lit(unknown))).drop("_asp")


def labels_in_scope(ann: DataFrame, entities: DataFrame, contract: DataFrame) -> DataFrame:
    """Binary labels restricted to known entities and contract terms."""
    a = ann.select("entity_id", "term_id").join(entities.select("entity_id"), "entity_id", "left_semi")
    return a.join(contract.select("term_id"), "term_id", "left_semi").distinct()


def scope_report(ann: DataFrame, entities: DataFrame, contract: DataFrame) -> DataFrame:
    """J3 report: rows kept, rows dropped for unknown entity, for out-of-contract term."""
    e = entities.select("entity_id").distinct().withColumn("_e", F.lit(True))
    c = contract.select("term_id").distinct().withColumn("_c", F.lit(True))
    j = ann.select("entity_id", "term_id").join(e, "entity_id", "left").join(c, "term_id", "left")
    return j.agg(F.count_if(F.col("_e").isNotNull() & F.col("_c").isNotNull()).alias("kept"),
                 F.count_if(F.col("_e").isNull()).alias("dropped_entity"),
                 F.count_if(F.col("_e").isNotNull() & F.col("_c").isNull()).alias("dropped_term"))


def align_taxonomy(entities: DataFrame, taxa: DataFrame, fill: int = 0) -> DataFrame:
    """Taxon per entity, missing -> ``fill``."""
    t = taxa.select("entity_id", F.col("taxon_id").alias("_t"))
    return entities.join(t, "entity_id", "left") \
        .withColumn("taxon_id", F.coalesce(F.col("_t"), F.lit(fill)).cast("int")).drop("_t")


def align_text(entities: DataFrame, corpus: DataFrame, raw_col: str, norm_col: str) -> DataFrame:
    """Text by raw key, else by normalised key, else ''.  Of several texts under
    a key the first in code-point order counts, so an entity stays one row."""
    c = corpus.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("text").alias("text"))
    r = entities.join(c.select(F.col("key").alias(raw_col), F.col("text").alias("_t1")), raw_col, "left")
    r = r.join(c.select(F.col("key").alias(norm_col), F.col("text").alias("_t2")), norm_col, "left")
    return r.withColumn("text", F.coalesce("_t1", "_t2", F.lit(""))).drop("_t1", "_t2")


def filter_to_entities(rows: DataFrame, entities: DataFrame, key: str = "entity_id") -> DataFrame:
    """Early semi join to the entity set."""
    return rows.join(entities.select(key).distinct(), key, "left_semi")


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Matched / only-left / only-right distinct key counts."""
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    j = a.join(b, key, "full_outer")
    return j.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
                 F.count_if(F.col("_r").isNull()).alias("only_left"),
                 F.count_if(F.col("_l").isNull()).alias("only_right"))


def key_overlap_report(left: DataFrame, right: DataFrame, key: str, clean, samples: int = 5) -> DataFrame:
    """J7 in full: one row for the keys as they are (``raw``) and one for the keys made clean by ``clean`` (column ->
    column): distinct keys of each side, matched keys, their share of the left keys, and the first ``samples`` keys that
    only one side has, joined by commas.  Null keys count on neither side."""
    def forms(df: DataFrame, side: str) -> DataFrame:
        k = F.col(key).cast("string")
        both = F.array(*[F.struct(F.lit(form).alias("form"), c.alias("k")) for form, c in (("raw", k), ("clean", clean(k)))])
        return df.select(F.inline(both)).where("k IS NOT NULL").select(
            "form", "k", F.lit(side == "left").alias("l"), F.lit(side == "right").alias("r"))

    keys = forms(left, "left").unionByName(forms(right, "right")).groupBy("form", "k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    first = Window.partitionBy("form", "l", "r").orderBy("k")
    shown = (keys.where(~(F.col("l") & F.col("r"))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= samples)
             .groupBy("form").agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col(c), F.col("k")))), ",").alias(f"sample_only_{name}")
                                    for c, name in (("l", "left"), ("r", "right"))]))
    n = keys.groupBy("form").agg(F.count_if("l").alias("n_left"), F.count_if("r").alias("n_right"),
                                 F.count_if(F.col("l") & F.col("r")).alias("matched"))
    return n.join(shown, "form", "left").select(
        "form", "n_left", "n_right", "matched", F.when(F.col("n_left") > 0, F.col("matched") / F.col("n_left")).alias("matched_share"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("sample_only_left", "sample_only_right")])


def truth_vs_prediction(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Full outer alignment; status tp / fp / fn per (entity, term)."""
    t = truth.select("entity_id", "term_id").distinct().withColumn("_t", F.lit(1))
    p = pred.select("entity_id", "term_id").distinct().withColumn("_p", F.lit(1))
    j = t.join(p, ["entity_id", "term_id"], "full_outer")
    st = (F.when(F.col("_t").isNotNull() & F.col("_p").isNotNull(), "tp")
          .when(F.col("_p").isNotNull(), "fp").otherwise("fn"))
    return j.select("entity_id", "term_id", st.alias("status"))


def frequency_baseline(entities: DataFrame, ann: DataFrame, top_n: int) -> DataFrame:
    """Every entity gets the top-N terms with ``prob = count / total rows``.

    The output is entities x N by definition.  The N-row list is bounded by
    the ``top_n`` parameter; it is one array, a scalar subquery that every task
    expands (a generate, not a join)."""
    probs = term_probabilities(ann).withColumnRenamed("prob", "n")
    top = global_top_k(probs, top_n).agg(F.collect_list(F.struct("term_id", F.col("n").alias("prob"))).alias("top")).scalar()
    e = entities.select("entity_id").distinct()
    return e.select("entity_id", F.explode(top).alias("t")).select("entity_id", "t.term_id", "t.prob")


def order_check(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Positional compare of two id listings ``(row_idx, id)``: status,
    first mismatching index and the two ids there."""
    j = a.select("row_idx", F.col(key).alias("a")).join(
        b.select("row_idx", F.col(key).alias("b")), "row_idx", "full_outer")
    same = F.col("a").eqNullSafe(F.col("b"))
    res = j.agg(F.count("*").alias("n"), F.min(F.when(~same, F.col("row_idx"))).alias("first_mismatch"))
    res = res.join(j.select(F.col("row_idx").alias("first_mismatch"), "a", "b"), "first_mismatch", "left")
    status = (F.when(F.col("n") == 0, "empty").when(F.col("first_mismatch").isNull(), "exact_match")
              .otherwise("mismatch"))
    return res.select(status.alias("status"), "first_mismatch", F.col("a").alias("left_id"),
                      F.col("b").alias("right_id"))


def reconcile_listings(expected: DataFrame, present: DataFrame, ignore_regex: str | None = None) -> DataFrame:
    """Expected ``(path, bytes)`` vs present listing: missing, size
    mismatch, unknown size (expected bytes null), ignoring paths by regex."""
    e = expected.select("path", F.col("bytes").alias("want"))
    p = present.select("path", F.col("bytes").alias("have"))
    if ignore_regex:
        e = e.filter(~F.col("path").rlike(ignore_regex))
    j = e.join(p, "path", "left")
    st = (F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unknown_size")
          .when(F.col("want") != F.col("have"), "size_mismatch").otherwise("ok"))
    return j.select("path", "want", "have", st.alias("status"))


def namespace_agreement(ann: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct (aspect, term) pairs whose ontology aspect differs / is known."""
    pairs = ann.select("aspect", "term_id").distinct()
    t = terms.select("term_id", F.col("aspect").alias("obo_aspect"))
    j = pairs.join(t, "term_id", "left")
    return j.agg(F.count("*").alias("pairs"), F.count("obo_aspect").alias("known"),
                 F.count_if(F.col("obo_aspect").isNotNull() & (F.col("obo_aspect") != F.col("aspect")))
                 .alias("disagree"))


def universe_check(ann_terms: DataFrame, ia: DataFrame, obo_terms: DataFrame,
                   alt_ids: DataFrame | None = None) -> DataFrame:
    """Distinct annotation terms missing in IA, missing in the ontology,
    and of those how many resolve through an alt id."""
    t = ann_terms.select("term_id").distinct()
    miss_ia = t.join(ia.select("term_id"), "term_id", "left_anti").agg(F.count("*").alias("missing_ia"))
    miss_obo_df = t.join(obo_terms.select("term_id"), "term_id", "left_anti")
    miss_obo = miss_obo_df.agg(F.count("*").alias("missing_obo"))
    if alt_ids is not None:
        alt = miss_obo_df.join(alt_ids.select(F.col("alt_id").alias("term_id")).distinct(),
                               "term_id", "left_semi").agg(F.count("*").alias("alt_resolvable"))
    else:
        alt = miss_obo.select(F.lit(0).cast("long").alias("alt_resolvable"))
    return miss_ia.select("missing_ia", miss_obo.scalar().alias("missing_obo"),
                          alt.scalar().alias("alt_resolvable"))


# ---------------------------------------------------------------- set operations
def union_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct union of two id sets."""
    return a.select(key).unionByName(b.select(key)).distinct()


def pairwise_overlap(lists: DataFrame, list_col: str, item_col: str) -> DataFrame:
    """U4: size of the intersection of every pair of lists (few lists, e.g. aspects)."""
    x = lists.select(F.col(list_col).alias("a"), item_col).distinct()
    y = lists.select(F.col(list_col).alias("b"), item_col).distinct()
    j = x.join(y, item_col).filter(F.col("a") < F.col("b"))
    return j.groupBy("a", "b").agg(F.count("*").alias("overlap"))


def ordered_dedup(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Keep the first occurrence (lowest ``pos``) of every key."""
    return df.groupBy(key).agg(F.min(pos).alias(pos))


# ---------------------------------------------------------------- contract audits
# Verdict strings of the target-expansion audit.
VERDICT_OK = "AUDIT VERDICT: STABLE FOR EXPERIMENTATION."
VERDICT_REJECT = "CRITICAL AUDIT VERDICT: REJECT EXPANSION."


def _ranked(counts: DataFrame) -> DataFrame:
    c = counts.withColumn("_g", F.lit(0))
    return stats.group_positions(c, ["_g"], [F.col("n").desc(), F.col("term_id")], out="rank0").drop("_g")


def head_tail_audit(counts: DataFrame, ia: DataFrame, base_k: int, expanded_k: int, noise_floor: int) -> DataFrame:
    """Split the frequency ranking (count desc, term asc) into the base
    block (first ``base_k``) and the tail up to ``expanded_k``; tail count
    statistics (mean, median, p10, p25 — linear), sums and IA sums of both,
    the share of tail terms below the noise floor and the verdict (REJECT
    when more than half of the tail is below the floor)."""
    r = _ranked(counts).join(ia.select("term_id", F.col("ia").alias("_ia")), "term_id", "left")
    r = r.withColumn("missing_ia", F.col("_ia").isNull()).withColumn("ia", F.coalesce("_ia", F.lit(0.0)))
    n_terms = r.agg(F.count("*")).scalar()
    r = r.withColumn("part", F.when(F.col("rank0") < base_k, "base")
                     .when(F.col("rank0") < expanded_k, "tail"))
    b = r.filter(F.col("part") == "base").agg(F.min("n").alias("base_min_count"),
                                              F.sum("n").cast("double").alias("sum_counts_base"),
                                              F.sum("ia").alias("ia_sum_base"))
    tail = r.filter(F.col("part") == "tail")
    t = tail.agg(F.count("*").alias("tail_k"), F.max("n").alias("tail_max_count"),
                 F.min("n").alias("tail_min_count"), F.avg("n").alias("tail_mean_count"),
                 F.sum("n").cast("double").alias("sum_counts_tail"), F.sum("ia").alias("ia_sum_tail"),
                 F.count_if(F.col("n") < noise_floor).alias("tail_below_noise_n"))
    q = stats.exact_quantiles(tail.select(F.col("n").cast("double").alias("n")), "n",
                              {"tail_median_count": 0.5, "tail_p10_count": 0.1, "tail_p25_count": 0.25})
    miss = r.agg(F.count_if("missing_ia").alias("missing_ia_terms_n"))
    ts = t.select(F.struct(*t.columns).alias("s")).scalar()  # one subquery for all tail stats
    qs = q.select(F.struct(*q.columns).alias("s")).scalar()
    out = b.select("*", *[ts.getField(c).alias(c) for c in t.columns],
                   *[qs.getField(c).alias(c) for c in q.columns], miss.scalar().alias("missing_ia_terms_n"))
    return out.select(
        n_terms.alias("total_terms_available"), "*",
        (F.col("sum_counts_tail") / F.col("sum_counts_base")).alias("sum_counts_tail_over_base"),
        (F.col("ia_sum_tail") / F.col("ia_sum_base")).alias("ia_tail_over_base"),
        (F.col("tail_below_noise_n") / F.greatest(F.col("tail_k"), F.lit(1))).alias("tail_below_noise_frac"),
        F.when(F.col("tail_below_noise_n") > F.col("tail_k") / 2, F.lit(VERDICT_REJECT))
        .otherwise(F.lit(VERDICT_OK)).alias("verdict"))


def elite_breakdown(counts: DataFrame, noise_floor: int, at_rank: int) -> DataFrame:
    """Per aspect the number of elite (``n >= noise_floor``) and rare
    terms, their annotation shares, p50 / p90 counts of each group, and the
    cumulative annotation coverage of the global ranking at ``at_rank``."""
    r = _ranked(counts)
    total = r.agg(F.sum("n")).scalar()
    cover = r.filter(F.col("rank0") < at_rank).agg((F.sum("n") / total).alias("coverage_at_rank")).scalar()
    g = r.withColumn("group", F.when(F.col("n") >= noise_floor, "elite").otherwise("rare"))
    agg = g.groupBy("aspect", "group").agg(F.count("*").alias("terms"), F.sum("n").alias("annotations"))
    q = stats.exact_quantiles(g.select("aspect", "group", F.col("n").cast("double").alias("n")), "n",
                              {"p50": 0.5, "p90": 0.9}, by=["aspect", "group"])
    share = F.col("annotations") / F.sum("annotations").over(Window.partitionBy("aspect"))
    return agg.join(q, ["aspect", "group"]).select("aspect", "group", "terms", "annotations",
                                                   share.alias("share"), "p50", "p90",
                                                   cover.alias("coverage_at_rank"))


def contract_guards(contract: DataFrame, labels: DataFrame, entities: DataFrame,
                    expected: dict[str, int]) -> DataFrame:
    """One row of contract checks — total / per-aspect sizes vs expected,
    duplicate ids, contiguous per-aspect column blocks, aspects without any
    label, entities without any in-contract label (warn above 1000) — with
    ``ok``.  ``raise_if_bad`` turns it into a failing job."""
    c = contract.select("term_id", "aspect", "col_idx")
    per = c.groupBy("aspect").agg(F.count("*").alias("n"), F.min("col_idx").alias("lo"),
                                  F.max("col_idx").alias("hi"))
    blocks_ok = per.agg(F.bool_and(F.col("hi") - F.col("lo") + 1 == F.col("n"))).scalar()
    sizes_ok = per.agg(F.bool_and(F.coalesce(F.col("n") == F.element_at(
        F.create_map(*[x for a, k in expected.items() for x in (F.lit(a), F.lit(k))]), F.col("aspect")),
        F.lit(False)))).scalar()
    dups = c.groupBy("term_id").count().agg(F.count_if(F.col("count") > 1)).scalar()
    in_scope = labels.select("entity_id", "term_id").join(c, "term_id")
    zero_aspects = per.join(in_scope.select("aspect").distinct(), "aspect", "left_anti").agg(F.count("*")).scalar()
    zero_entities = entities.select("entity_id").distinct().join(in_scope.select("entity_id").distinct(),
                                                                 "entity_id", "left_anti").agg(F.count("*")).scalar()
    out = c.agg(F.count("*").alias("terms")).select(
        "terms", sizes_ok.alias("sizes_ok"), blocks_ok.alias("blocks_ok"), dups.alias("duplicate_ids"),
        zero_aspects.alias("zero_label_aspects"), zero_entities.alias("zero_label_entities"))
    ok = (F.col("terms") > 0) & F.col("sizes_ok") & F.col("blocks_ok") & (F.col("duplicate_ids") == 0) \
        & (F.col("zero_label_aspects") == 0)
    return out.withColumn("ok", ok).withColumn("warn_zero_label_entities", F.col("zero_label_entities") > 1000)


def raise_if_bad(guards: DataFrame) -> DataFrame:
    """Fail the job when a guard row is not ``ok``."""
    return guards.withColumn("ok", F.when(F.col("ok"), F.lit(True))
                             .otherwise(F.raise_error(F.lit("contract guard failed"))))


def random_row_sample(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """``n`` rows without replacement, deterministic for a seed (hash
    order, not numpy's generator), returned sorted by id.  The limit is the
    feature; Spark plans it as a per-partition top-n then a final merge."""
    return df.orderBy(_drawn(id_col, seed), F.col(id_col)).limit(n).orderBy(id_col)
