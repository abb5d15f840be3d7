"""Queries over similarities, predictions and labels: scores, verdicts, metrics, calibration, experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import scoring as S
from corpusloom.functions import text as X
from corpusloom.operators import metrics as M
from corpusloom.operators import ranks, sampling, similarity
from corpusloom.registry import query
from corpusloom.session import table


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


# ---- similarity: every tenth vector is a sentence of one of 25 articles, the others are the two corpora

PAIRS = """p as (select q.vec_id as qid, c.vec_id as cid, (c.label >= 5)::int as cls, list_dot_product(q.embedding::double[], c.embedding::double[]) as score from embeddings q join embeddings c on q.vec_id % 10 = 0 and c.vec_id % 10 <> 0)"""
BEST = PAIRS + """, b as (select qid, max(score) filter (cls = 0) as s0, max(score) filter (cls = 1) as s1 from p group by qid),
art as (select (qid // 10) % 25 as article, count(*) as n, avg(s0) as s0_mean, avg(s1) as s1_mean, avg(s1) - avg(s0) as diff_mean, min(s0) as s0_min, min(s1) as s1_min, quantile_cont(s0, 0.1) as s0_p10, quantile_cont(s1, 0.1) as s1_p10, min(s1) - min(s0) as diff_min, quantile_cont(s1, 0.1) - quantile_cont(s0, 0.1) as diff_p10 from b group by 1)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return q, e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("cid"), F.col("embedding").alias("c"), (F.col("label") >= 5).cast("int").alias("cls"))


def best_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s0 and s1 of each sentence: its best match in either corpus."""
    p = similarity.top_k_blocked(*sides(spark, sf_dir), 1, "cls")
    return p.groupBy("qid").agg(F.max(F.when(F.col("cls") == 0, F.col("score"))).alias("s0"), F.max(F.when(F.col("cls") == 1, F.col("score"))).alias("s1"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = best_scores(spark, sf_dir).withColumn("article", F.floor(F.col("qid") / 10) % 25)
    g = b.groupBy("article").agg(
        F.count("*").alias("n"), F.avg("s0").alias("s0_mean"), F.avg("s1").alias("s1_mean"), (F.avg("s1") - F.avg("s0")).alias("diff_mean"),
        F.min("s0").alias("s0_min"), F.min("s1").alias("s1_min"), F.percentile("s0", F.lit(0.1)).alias("s0_p10"), F.percentile("s1", F.lit(0.1)).alias("s1_p10"),
    )
    return g.withColumns({"diff_min": F.col("s1_min") - F.col("s0_min"), "diff_p10": F.col("s1_p10") - F.col("s0_p10")})


@query(f"with {PAIRS} select qid, round(max(score), 6) as score, arg_max(cid, (score, -cid)) as cid from p group by qid")
def top1_similarity(spark, sf_dir):
    q, c = sides(spark, sf_dir)
    return similarity.top_k_blocked(q, c.drop("cls"), 1).select("qid", *r6("score"), "cid")


@query(f"with {PAIRS} select qid, cls, round(max(score), 6) as score, arg_max(cid, (score, -cid)) as cid from p group by qid, cls")
def top1_by_label(spark, sf_dir):
    return similarity.top_k_blocked(*sides(spark, sf_dir), 1, "cls").select("qid", "cls", *r6("score"), "cid")


@query(f"with {PAIRS}, r as (select *, row_number() over (partition by qid, cls order by score desc, cid) as rk from p) select qid, cls, round(avg(score), 6) as score from r where rk <= 5 group by qid, cls")
def topk_mean_similarity(spark, sf_dir):
    return similarity.top_k_blocked(*sides(spark, sf_dir), 5, "cls").groupBy("qid", "cls").agg(F.avg("score").alias("score")).select("qid", "cls", *r6("score"))


@query(f"with {BEST}, r as (select qid, (qid // 10) % 25 as article, s1, row_number() over (partition by (qid // 10) % 25 order by s1 desc, qid) as rk from b), m as (select qid, cls, arg_max(cid, (score, -cid)) as cid from p group by qid, cls) select article, rk::int as rk, r.qid, round(s1, 6) as s1, m.cid, e.label from r join m on m.qid = r.qid and m.cls = 1 join embeddings e on e.vec_id = m.cid where rk <= 3")
def top3_matches(spark, sf_dir):
    """The three sentences of each article closest to class 1, with the matched row's attributes joined back."""
    b = similarity.top_k_blocked(*sides(spark, sf_dir), 1, "cls").where("cls = 1").withColumn("article", F.floor(F.col("qid") / 10) % 25)
    w = Window.partitionBy("article").orderBy(F.desc("score"), "qid")
    top = b.withColumn("rk", F.row_number().over(w)).where("rk <= 3")
    src = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cid"), "label")
    return top.join(src, "cid").select("article", "rk", "qid", F.round("score", 6).alias("s1"), "cid", "label")


@query(f"with {PAIRS}, r as (select qid, cid, score, row_number() over (partition by qid order by score desc, cid) as rk from p) select qid, cid, round(score, 6) as score from r where rk <= 3")
def blocked_topk(spark, sf_dir):
    q, c = sides(spark, sf_dir)
    return similarity.top_k_blocked(q, c.drop("cls"), 3).select("qid", "cid", *r6("score"))


_A = ("s0_mean", "s1_mean", "diff_mean", "s0_min", "s1_min", "diff_min", "s0_p10", "s1_p10", "diff_p10")


@query(f"with {BEST} select article, n, {', '.join(f'round({c}, 6) as {c}' for c in _A)}, (diff_mean > -0.0073)::int as pred from art")
def article_scores(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("article", "n", *r6(*_A), (F.col("diff_mean") > S.TAU).cast("int").alias("pred"))


@query(f"with {BEST} select (qid // 10) % 25 as article, {', '.join(f'round(avg((s1 < 0.{t})::int), 6) as below_{t}' for t in (3, 4, 5, 6))} from b group by 1")
def share_below_tau(spark, sf_dir):
    b = best_scores(spark, sf_dir).withColumn("article", F.floor(F.col("qid") / 10) % 25)
    return b.groupBy("article").agg(*[F.round(F.avg((F.col("s1") < t / 10).cast("int")), 6).alias(f"below_{t}") for t in (3, 4, 5, 6)])


_P1 = "(article % 10) / 10.0::double"


@query(f"""with {BEST}, v as (select article, n, diff_mean as d, {_P1} as p1 from art) select article, case when d > -0.0073 then 'cls1' else 'cls0' end as verdict, round((tanh(50 * (d + 0.0073)) + 1) / 2, 6) as confidence,
case when d <= -0.0073 and p1 > 0.8 then 'dezacord_m2_cls1_m3_cls0' when d > -0.0073 and p1 < 0.2 then 'dezacord_m3_cls1_m2_cls0' when abs(d + 0.0073) < 0.003 then 'proximitate_threshold' when n < 3 then 'esantion_mic' end as reason,
case when d + 0.0073 > 0.03 then 'strong_1' when d + 0.0073 > 0.0073 then 'weak_1' when d + 0.0073 >= -0.0073 then 'unclear' when d + 0.0073 >= -0.03 then 'weak_0' else 'strong_0' end as band from v""")
def verdict_policy(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("p1", (F.col("article") % 10) / F.lit(10.0))
    d = F.col("diff_mean")
    return a.select("article", S.verdict(d).alias("verdict"), F.round(S.confidence(d), 6).alias("confidence"), S.borderline(d, F.col("p1"), F.col("n")).alias("reason"), S.band(d).alias("band"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as length, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as first from embeddings")
def unit_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(similarity.dot(F.col("embedding"), F.col("embedding"))), 6).alias("length"), F.round(S.unit(F.col("embedding"))[0], 6).alias("first"))


# ---- predictions: label quality against a score from the text's length

PRED = "d as (select doc_id, source, lang, n_chars, quality as y, n_chars / 1000.0::double as score, (n_chars / 1000.0::double > 1.2)::int as pred from documents join labels using (doc_id))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides are keyed by doc_id; only narrow columns are read."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return d.withColumn("score", F.col("n_chars") / F.lit(1000.0)).withColumn("pred", (F.col("score") > 1.2).cast("int"))


_CELLS = "count(*) filter (y = 1 and pred = 1) as tp, count(*) filter (y = 0 and pred = 1) as fp, count(*) filter (y = 1 and pred = 0) as fn, count(*) filter (y = 0 and pred = 0) as tn"
_RATES = "round(coalesce((tp + tn)::double / nullif(tp + fp + fn + tn, 0), 0), 6) as accuracy, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1"
_RATE = ("accuracy", "precision", "recall", "f1")


@query(f"with {PRED}, c as (select {_CELLS} from d) select tp, fp, fn, tn, {_RATES} from c")
def confusion(spark, sf_dir):
    return M.rates(M.confusion(predictions(spark, sf_dir))).select("tp", "fp", "fn", "tn", *r6(*_RATE))


@query(f"with {PRED}, c as (select source, {_CELLS} from d group by source) select source, tp, fp, fn, tn, {_RATES} from c")
def prf_by_source(spark, sf_dir):
    return M.rates(M.confusion(predictions(spark, sf_dir), "source")).select("source", "tp", "fp", "fn", "tn", *r6(*_RATE))


@query(f"with {PRED}, c as (select {_CELLS} from d) select round((coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0::double * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) as macro_f1 from c")
def macro_f1(spark, sf_dir):
    c = M.confusion(predictions(spark, sf_dir))
    f = lambda t: S.ratio(2 * F.col(t), 2 * F.col(t) + F.col("fp") + F.col("fn"))
    return c.select(F.round((f("tp") + f("tn")) / 2, 6).alias("macro_f1"))


@query("select quality, count(*) as n, round(sum(count(*)) over () / (2.0::double * count(*)), 6) as weight from labels group by quality")
def class_weights(spark, sf_dir):
    c = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"))
    return c.select("quality", "n", F.round(F.sum("n").over(Window.partitionBy()) / (F.lit(2.0) * F.col("n")), 6).alias("weight"))


_AUC = "select {k} round((sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double) / nullif(count(*) filter (y = 1) * count(*) filter (y = 0), 0), 6) as auc from (select *, rank() over ({w} order by score) + (count(*) over (partition by {p} score) - 1) / 2.0::double as r from d) {g}"


@query(f"with {PRED} " + _AUC.format(k="", w="", p="", g=""))
def auc(spark, sf_dir):
    return M.auc(predictions(spark, sf_dir)).select(*r6("auc"))


@query(f"with {PRED} " + _AUC.format(k="source,", w="partition by source", p="source,", g="group by source"))
def auc_by_source(spark, sf_dir):
    return M.auc(predictions(spark, sf_dir), "source").select("source", *r6("auc"))


_D = "round((avg(score) filter (y = 1) - avg(score) filter (y = 0)) / sqrt(((count(*) filter (y = 1) - 1) * var_samp(score) filter (y = 1) + (count(*) filter (y = 0) - 1) * var_samp(score) filter (y = 0)) / (count(*) - 2)), 6) as cohen_d"


@query(f"with {PRED} select {_D} from d")
def cohen_d(spark, sf_dir):
    return M.cohen_d(predictions(spark, sf_dir)).select(*r6("cohen_d"))


@query(f"with {PRED} select round(avg(score) filter (source = 'src1') - avg(score) filter (source = 'src2'), 6) as gap from d where y = 1")
def source_gap(spark, sf_dir):
    p = predictions(spark, sf_dir).where("y = 1")
    return p.agg(F.round(F.avg(F.when(F.col("source") == "src1", F.col("score"))) - F.avg(F.when(F.col("source") == "src2", F.col("score"))), 6).alias("gap"))


@query(f"with {PRED} select y, round(corr(score, doc_id::double), 6) as r from d group by y")
def pearson_by_class(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("y").agg(F.round(M.pearson("score", F.col("doc_id").cast("double")), 6).alias("r"))


@query(f"with {PRED}, c as (select score, count(*) filter (y = 1) as n1, count(*) filter (y = 0) as n0 from d group by score), g as (select abs(sum(n1) over (order by score) / sum(n1) over ()::double - sum(n0) over (order by score) / sum(n0) over ()::double) as gap from c) select round(max(gap), 6) as ks from g")
def ks_two_sample(spark, sf_dir):
    return M.ks(predictions(spark, sf_dir)).select(*r6("ks"))


@query(f"""with {PRED}, r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as r from d), s as (select sum(r) filter (y = 1) as r1, (count(*) filter (y = 1))::double as n1, (count(*) filter (y = 0))::double as n0 from r)
select round(r1 - n1 * (n1 + 1) / 2, 6) as u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n0 / 2) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12), 6) as z from s""")
def mann_whitney(spark, sf_dir):
    """U of class 1 and its normal approximation (no tie correction)."""
    p = predictions(spark, sf_dir)
    n = p.groupBy("score").agg(F.count_if(F.col("y") == 1).cast("double").alias("a"), F.count_if(F.col("y") == 0).cast("double").alias("b"))
    n = ranks.below(n, [], "score", {"below": "b"})
    s = n.agg(F.sum(F.col("a") * (F.col("below") + F.col("b") / 2)).alias("u"), F.sum("a").alias("n1"), F.sum("b").alias("n0"))
    return s.select(F.round("u", 6).alias("u"), F.round((F.col("u") - F.col("n1") * F.col("n0") / 2) / F.sqrt(F.col("n1") * F.col("n0") * (F.col("n1") + F.col("n0") + 1) / 12), 6).alias("z"))


@query(f"""with {PRED}, x as (select score - (doc_id % 7) / 2.0::double as d from d), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0::double as r from x where d <> 0)
select round(sum(r) filter (d > 0), 6) as w_plus, round(sum(r) filter (d < 0), 6) as w_minus, count(*) as n from r""")
def wilcoxon(spark, sf_dir):
    x = predictions(spark, sf_dir).select((F.col("score") - (F.col("doc_id") % 7) / F.lit(2.0)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    n = x.groupBy("m").agg(F.count_if(F.col("d") > 0).alias("p"), F.count_if(F.col("d") < 0).alias("q"))
    n = ranks.below(n.withColumn("_t", F.col("p") + F.col("q")), [], "m", {"_before": "_t"})
    n = n.withColumn("r", F.col("_before") + (F.col("p") + F.col("q") + 1) / F.lit(2.0))
    return n.agg(F.round(F.sum(F.col("p") * F.col("r")), 6).alias("w_plus"), F.round(F.sum(F.col("q") * F.col("r")), 6).alias("w_minus"), F.sum(F.col("p") + F.col("q")).alias("n"))


# ---- calibration

_GRID = "g as (select i, lo + i * (hi - lo) / 199.0::double as tau from (select min(score) as lo, max(score) as hi from {t}) l, generate_series(0, 199) s(i))"
_F1 = "coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0)"


def grid(rows: DataFrame, *by: str, points: int = 200) -> DataFrame:
    """`points` thresholds from the least to the greatest score of each group."""
    b = rows.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return b.select(*by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select(*by, "i", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / F.lit(points - 1.0)).alias("tau"))


def curve(rows: DataFrame, taus: DataFrame, *by: str) -> DataFrame:
    """Confusion counts at each threshold of an ascending grid.

    A row goes once to a cell, the number of thresholds under its score; cells are summed within tasks, and running sums over
    the cells (a fixed number for each group) give the counts. The grid is one array per group, so it is the broadcast side.
    """
    lists = taus.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "tau"))).alias("g"))
    j = rows.join(F.broadcast(lists), list(by)) if by else rows.crossJoin(F.broadcast(lists))
    cell = F.size(F.filter("g", lambda x: x["tau"] < F.col("score")))
    n = j.groupBy(*by, cell.alias("cell")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    w = Window.partitionBy(*by)
    grid_ = taus.select(*by, "i", "tau", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.col("i").alias("cell"), F.lit(1).alias("is_grid"))
    both = grid_.unionByName(n.select(*by, F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("tau"), "p", "q", "cell", F.lit(0).alias("is_grid")))
    # a row passes threshold i if more than i thresholds are under its score
    low = lambda c: F.sum(c).over(w.orderBy("cell", "is_grid").rowsBetween(Window.unboundedPreceding, 0))
    all_ = lambda c: F.sum(c).over(w)
    out = both.withColumns({"fn": low("p"), "tn": low("q"), "p1": all_("p"), "q1": all_("q")}).where("is_grid = 1")
    return out.select(*by, "i", "tau", (F.col("p1") - F.col("fn")).alias("tp"), (F.col("q1") - F.col("tn")).alias("fp"), "fn", "tn")


@query(f"with {PRED}, {_GRID.format(t='d')}, c as (select i, tau, count(*) filter (y = 1 and score > tau) as tp, count(*) filter (y = 0 and score > tau) as fp, count(*) filter (y = 1 and score <= tau) as fn from d, g group by i, tau) select i::int as i, round(tau, 6) as tau, tp, fp, fn, round({_F1}, 6) as f1 from c")
def threshold_grid(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return M.rates(curve(p, grid(p))).select("i", *r6("tau"), "tp", "fp", "fn", *r6("f1"))


@query(f"with {PRED}, {_GRID.format(t='d')}, c as (select i, tau, count(*) filter (y = 1 and score > tau) as tp, count(*) filter (y = 0 and score > tau) as fp, count(*) filter (y = 1 and score <= tau) as fn from d, g group by i, tau) select round(tau, 6) as tau, round({_F1}, 6) as f1 from c order by {_F1} desc, i limit 1")
def threshold_oracle(spark, sf_dir):
    """The threshold with the best F1; the first of equals."""
    p = predictions(spark, sf_dir)
    return M.rates(curve(p, grid(p))).orderBy(F.desc("f1"), "i").limit(1).select(*r6("tau", "f1"))


_FOLD = "f as (select *, (row_number() over (partition by y order by md5('42|' || doc_id), doc_id) - 1) % 5 as fold from d), k as (select k from generate_series(0, 4) t(k)), tr as (select k, y, score from f, k where fold <> k)"


@query(f"""with {PRED}, {_FOLD}, g as (select k, i, lo + i * (hi - lo) / 199.0::double as tau from (select k, min(score) as lo, max(score) as hi from tr group by k) l, generate_series(0, 199) s(i)),
c as (select tr.k, i, tau, count(*) filter (y = 1 and score > tau) as tp, count(*) filter (y = 0 and score > tau) as fp, count(*) filter (y = 1 and score <= tau) as fn from tr join g on g.k = tr.k group by tr.k, i, tau),
b as (select k, tau from (select *, row_number() over (partition by k order by {_F1} desc, i) as rn from c) where rn = 1),
e as (select b.k, b.tau, count(*) filter (y = 1 and score > tau) as tp, count(*) filter (y = 0 and score > tau) as fp, count(*) filter (y = 1 and score <= tau) as fn, count(*) filter (y = 0 and score <= tau) as tn from f join b on f.fold = b.k group by b.k, b.tau)
select k::int as fold, round(tau, 6) as tau, tp, fp, fn, tn, {_RATES} from e""")
def threshold_cv(spark, sf_dir):
    return threshold_folds(spark, sf_dir).select("fold", *r6("tau"), "tp", "fp", "fn", "tn", *r6(*_RATE))


def threshold_folds(spark, sf_dir):
    """Five stratified folds: the best threshold of four, judged on the fifth."""
    f = sampling.folds(predictions(spark, sf_dir), ["y"], 5, "doc_id")
    train = f.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("fold <> k").select("k", "y", "score")
    c = M.rates(curve(train, grid(train, "k"), "k"))
    best = c.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("f1"), "i"))).where("rn = 1").select(F.col("k").alias("fold"), "tau")
    e = f.join(F.broadcast(best), "fold").withColumn("pred", (F.col("score") > F.col("tau")).cast("int"))
    return M.rates(M.confusion(e, "fold", "tau"))


_CV = f"""with {PRED}, {_FOLD}, g as (select k, i, lo + i * (hi - lo) / 199.0::double as tau from (select k, min(score) as lo, max(score) as hi from tr group by k) l, generate_series(0, 199) s(i)),
c as (select tr.k, i, tau, count(*) filter (y = 1 and score > tau) as tp, count(*) filter (y = 0 and score > tau) as fp, count(*) filter (y = 1 and score <= tau) as fn from tr join g on g.k = tr.k group by tr.k, i, tau),
b as (select k, tau from (select *, row_number() over (partition by k order by {_F1} desc, i) as rn from c) where rn = 1),
e as (select b.k, b.tau, count(*) filter (y = 1 and score > tau) as tp, count(*) filter (y = 0 and score > tau) as fp, count(*) filter (y = 1 and score <= tau) as fn, count(*) filter (y = 0 and score <= tau) as tn from f join b on f.fold = b.k group by b.k, b.tau),
x as (select k, tau, {_RATES} from e)"""


@query(_CV + " select round(avg(tau), 6) as tau_mean, round(stddev_samp(tau), 6) as tau_std, round(avg(f1), 5) as f1_mean, round(stddev_samp(f1), 5) as f1_std, count(*) as folds from x")
def threshold_cv_summary(spark, sf_dir):
    """The calibrated threshold: mean and standard deviation (ddof 1) over folds, and of the F1 that it gets."""
    t = threshold_folds(spark, sf_dir)
    return t.agg(F.round(F.avg("tau"), 6).alias("tau_mean"), F.round(F.stddev_samp("tau"), 6).alias("tau_std"), F.round(F.avg("f1"), 5).alias("f1_mean"), F.round(F.stddev_samp("f1"), 5).alias("f1_std"), F.count("*").alias("folds"))


# ---- experiments

_LONG = PRED + ", l as (select y, source, t.k as test, case t.k when 'a' then score when 'b' then -score else score * (doc_id % 3) end as score from d, (values ('a'), ('b'), ('d')) t(k))"


def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scores of each document in long form."""
    p = predictions(spark, sf_dir)
    s = F.array(F.struct(F.lit("a").alias("test"), F.col("score").alias("s")), F.struct(F.lit("b").alias("test"), (-F.col("score")).alias("s")), F.struct(F.lit("d").alias("test"), (F.col("score") * (F.col("doc_id") % 3)).alias("s")))
    return p.select("doc_id", "y", "source", F.explode(s).alias("x")).select("doc_id", "y", "source", "x.test", F.col("x.s").alias("score"))


def matrix(rows: DataFrame, *by: str) -> DataFrame:
    gap = rows.where("y = 1").groupBy(*by).agg((F.avg(F.when(F.col("source") == "src1", F.col("score"))) - F.avg(F.when(F.col("source") == "src2", F.col("score")))).alias("gap"))
    return M.auc(rows, *by).join(M.cohen_d(rows, *by), list(by)).join(gap, list(by)).select(*by, *r6("auc", "cohen_d", "gap"))


_MATRIX = "r as (select *, rank() over (partition by {b} order by score) + (count(*) over (partition by {b}, score) - 1) / 2.0::double as r from l) select {b}, round((sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double) / nullif(count(*) filter (y = 1) * count(*) filter (y = 0), 0), 6) as auc, " + _D + ", round(avg(score) filter (y = 1 and source = 'src1') - avg(score) filter (y = 1 and source = 'src2'), 6) as gap from r group by {b}"


@query(f"with {_LONG}, " + _MATRIX.format(b="test"))
def metric_matrix(spark, sf_dir):
    return matrix(long_scores(spark, sf_dir), "test")


@query(f"with {_LONG.replace(', l as', ', l0 as')}, l as (select s.k as scenario, l0.* from l0, (values ('all'), ('src3'), ('src4')) s(k) where l0.source <> s.k), " + _MATRIX.format(b="scenario, test"))
def loso_metrics(spark, sf_dir):
    """Leave-one-source-out: the matrix without each of two sources, and with all."""
    rows = long_scores(spark, sf_dir).withColumn("scenario", F.explode(F.array(F.lit("all"), F.lit("src3"), F.lit("src4")))).where("source <> scenario")
    return matrix(rows, "scenario", "test")


@query(f"with {PRED}, s as (select lang, y, score, n_chars from d where n_chars between 500 and 3000) select lang, count(*) as n, min(n_chars) as least, round(corr(score, y::double), 6) as r, round(avg(score) filter (y = 1), 6) as mean1, round(avg(score) filter (y = 0), 6) as mean0 from s group by lang")
def length_probe(spark, sf_dir):
    """Does a metric follow from length? Balanced range, correlation with the label, means by class."""
    s = predictions(spark, sf_dir).where(F.col("n_chars").between(500, 3000))
    m = lambda y: F.round(F.avg(F.when(F.col("y") == y, F.col("score"))), 6)
    return s.groupBy("lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.round(M.pearson("score", F.col("y").cast("double")), 6).alias("r"), m(1).alias("mean1"), m(0).alias("mean0"))


@query(r"with d as (select doc_id, quality as y, len(regexp_extract_all(text, '[^\x00-\x7F]')) as before, len(regexp_extract_all(regexp_replace(text, '[àâäçéèêëîïôöùûüßñáíóú]', '', 'g'), '[^\x00-\x7F]')) as after from documents join labels using (doc_id)), s as (select y, (before > 5)::int as p, (after > 5)::int as q, before - after as delta from d) select y, count(*) as n, round(avg(delta), 6) as mean_delta, round(avg((p <> q)::int), 6) as flip_rate from s group by y")
def ablation_study(spark, sf_dir):
    """Predict before and after an ablation: mean change and share of flips by class."""
    t = F.col("text")
    d = table(spark, sf_dir, "documents").select("doc_id", X.n_matches(t, r"[^\x00-\x7F]").alias("before"), X.n_matches(X.ablate(t, "[àâäçéèêëîïôöùûüßñáíóú]", ""), r"[^\x00-\x7F]").alias("after"))
    d = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    flip = ((F.col("before") > 5) != (F.col("after") > 5)).cast("int")
    return d.groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg(F.col("before") - F.col("after")), 6).alias("mean_delta"), F.round(F.avg(flip), 6).alias("flip_rate"))


@query(f"with {PRED}, t as (select k, avg(greatest(score - k / 10.0::double, 0)) as kept, avg(score) - avg(greatest(score - k / 10.0::double, 0)) as d from d, (values (1), (3), (5), (10)) v(k) group by k) select k, round(d, 6) as drop_mean, round(avg(d) over (), 6) as auc from t")
def deletion_curve(spark, sf_dir):
    """Mean drop of a score after k deletions, and the mean over k (1, 3, 5, 10)."""
    p = predictions(spark, sf_dir).withColumn("k", F.explode(F.array(*map(F.lit, (1, 3, 5, 10)))))
    t = p.groupBy("k").agg((F.avg("score") - F.avg(F.greatest(F.col("score") - F.col("k") / F.lit(10.0), F.lit(0.0)))).alias("d"))
    return t.select("k", F.round("d", 6).alias("drop_mean"), F.round(F.avg("d").over(Window.partitionBy()), 6).alias("auc"))


@query(f"with {PRED}, g as (select doc_id % 4 as period, count(*) filter (y = 1) as n, count(*) filter (y = 1 and pred = 1) as hit from d group by 1) select period, n, hit, round(hit::double / n, 6) as recall, round(sum(hit) over () / sum(n) over ()::double, 6) as weighted from g")
def temporal_recall(spark, sf_dir):
    """Recall by period and weighted over periods."""
    g = predictions(spark, sf_dir).groupBy((F.col("doc_id") % 4).alias("period")).agg(F.count_if(F.col("y") == 1).alias("n"), F.count_if((F.col("y") == 1) & (F.col("pred") == 1)).alias("hit"))
    w = Window.partitionBy()
    return g.select("period", "n", "hit", F.round(F.col("hit") / F.col("n"), 6).alias("recall"), F.round(F.sum("hit").over(w) / F.sum("n").over(w), 6).alias("weighted"))
