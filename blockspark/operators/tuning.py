"""Measurements of configurations: validation, averaging, utility, ranking and evaluation.

Measurement rows: graph, config, run, inverse_hnorm, modularity, conductance, teps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import hash_uniform, log_q_approx
from .graph import with_totals

# fixed values: other names of measurement columns
ALIASES = {"Result Batch": "Dataset", "Graph": "Graph Name", "Parameter": "Configuration", "Parameter ID": "Configuration ID"}


def rename_aliases(df: DataFrame) -> DataFrame:
    """Known other names become the standard ones, where the standard one isn't there yet."""
    return df.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in df.columns and b not in df.columns})


def trailing_id(label: Column) -> Column:
    """The digits at the end of a label; an error without any."""
    digits = F.regexp_extract(label, r"(\d+)\s*$", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no number at the end of "), label)).cast("int"))


def switch(value: Column) -> Column:
    """off for 0, 0.0, false, off; on for 1, 1.0, true, on; without regard to case; otherwise an error."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("0", "0.0", "false", "off"), "off").when(v.isin("1", "1.0", "true", "on"), "on").otherwise(F.raise_error(F.concat(F.lit("not a switch: "), v)).cast("string"))


def config_label(config: Column) -> Column:
    return F.concat(F.lit("theta_"), config.cast("string"))


def graph_key(dataset: Column, graph: Column) -> Column:
    return F.concat_ws("::", dataset, graph)


def run_completeness(m: DataFrame, expected_runs: int) -> DataFrame:
    """(graph, config, runs) that don't have the expected number of rows."""
    return m.groupBy("graph", "config").agg(F.count("*").alias("runs")).where(F.col("runs") != expected_runs)


def config_consistency(conf: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, values) of configurations with more than one combination of feature values; null counts as a value."""
    return conf.groupBy(key).agg(F.count_distinct(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("\0")) for f in features])).alias("values")).where("values > 1")


def average_runs(m: DataFrame) -> DataFrame:
    """One row for each (graph, config): means of the outcomes, and the number of runs."""
    return m.groupBy("graph", "config").agg(*[F.avg(c).alias(c) for c in ("inverse_hnorm", "modularity", "conductance", "teps")], F.count("*").alias("runs"))


def weights_or_error(weights: tuple[float, float, float]) -> tuple[float, float, float]:
    if len(weights) != 3 or any(not math.isfinite(w) or w < 0 for w in weights) or not math.isclose(sum(weights), 1.0):
        raise ValueError("three weights that aren't negative and add up to 1 are asked for")
    return weights


def accuracy(weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)) -> Column:
    a, b, c = weights_or_error(weights)
    return a * F.col("inverse_hnorm") + b * F.col("modularity") + c * (1 - F.col("conductance"))


def utility(averaged: DataFrame, alphas: list[float], weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)) -> DataFrame:
    """averaged x alphas with accuracy, both normalised to the graph's best, and utility = alpha NA + (1 - alpha) NP."""
    w = Window.partitionBy("graph")
    d = averaged.withColumn("accuracy", accuracy(weights))
    d = d.withColumn("na", (F.exp(F.col("accuracy") / F.max("accuracy").over(w)) - 1) / (math.e - 1)).withColumn("np", F.col("teps") / F.max("teps").over(w))
    d = d.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    return d.withColumn("utility", F.col("alpha") * F.col("na") + (1 - F.col("alpha")) * F.col("np"))


def ranked(df: DataFrame, score: str, name: str = "rank") -> DataFrame:
    """df with each configuration's place within its graph and alpha: best score first, ties by configuration."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("graph", "alpha").orderBy(F.desc(score), "config")))


def priors(averaged: DataFrame, weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)) -> DataFrame:
    """(kind, config, wins, prior_rank): configurations by the number of graphs they win on accuracy and on performance."""
    d = averaged.withColumn("accuracy", accuracy(weights))
    long = d.select("graph", "config", F.explode(F.create_map(F.lit("accuracy"), F.col("accuracy"), F.lit("performance"), F.col("teps"))).alias("kind", "value"))
    best = long.groupBy("kind", "graph").agg(F.max(F.struct("value", (-F.col("config")).alias("minus"))).alias("x"))
    wins = best.groupBy("kind", (-F.col("x.minus")).alias("config")).agg(F.count("*").alias("wins"))
    every = long.select("kind", "config").distinct().join(wins, ["kind", "config"], "left").withColumn("wins", F.coalesce("wins", F.lit(0)))
    return every.withColumn("prior_rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("wins"), "config")))


def evaluate(df: DataFrame, rank: str = "rank") -> DataFrame:
    """One row for each (graph, alpha): top_1, top_5, ndcg_at_5, kendall_tau and relative errors of a ranking against utility.

    tau comes from the pairs of a graph's configurations (ranks are free of ties); gain is utility, discount log2(place + 1).
    """
    g = ["graph", "alpha"]
    d = df.withColumn("true_rank", F.row_number().over(Window.partitionBy(*g).orderBy(F.desc("utility"), "config")))
    pairs = d.select(*g, F.col(rank).alias("p1"), F.col("true_rank").alias("t1")).join(d.select(*g, F.col(rank).alias("p2"), F.col("true_rank").alias("t2")), g).where("p1 < p2")
    tau = pairs.groupBy(*g).agg(F.avg(F.signum(F.col("t2") - F.col("t1")).cast("double")).alias("kendall_tau"))
    gain = lambda r: F.sum(F.when(F.col(r) <= 5, F.col("utility") / F.log2(F.col(r) + 1)).otherwise(0.0))
    chosen = lambda c: F.max(F.when(F.col(rank) == 1, F.col(c)))

    def error(c: str) -> Column:
        hi, lo = F.max(c), F.min(c)
        return F.when(F.abs(hi - lo) <= 1e-8 + 1e-5 * F.abs(lo), 0.0).otherwise((hi - chosen(c)) / (hi - lo))

    one = d.groupBy(*g).agg(
        F.max(((F.col(rank) == 1) & (F.col("true_rank") == 1)).cast("double")).alias("top_1"),
        F.max(((F.col(rank) <= 5) & (F.col("true_rank") == 1)).cast("double")).alias("top_5"),
        (gain(rank) / gain("true_rank")).alias("ndcg_at_5"),
        error("utility").alias("utility_error"),
        error("accuracy").alias("accuracy_error"),
        error("teps").alias("performance_error"),
        F.max(F.when(F.col(rank) == 1, F.col("config"))).alias("selected"),
        F.max(F.when(F.col("true_rank") == 1, F.col("config"))).alias("best"),
    )
    return one.join(tau, g)


METRICS = ("top_1", "top_5", "ndcg_at_5", "kendall_tau", "utility_error", "accuracy_error", "performance_error")


def by_alpha(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("alpha").agg(*[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("pairs"))


def prior_ranking(df: DataFrame, prior: DataFrame) -> DataFrame:
    """df with ``rank``: accuracy's prior where alpha >= 0.5, else performance's."""
    wide = prior.groupBy("config").pivot("kind", ["accuracy", "performance"]).agg(F.first("prior_rank"))
    d = df.join(wide.withColumnsRenamed({"accuracy": "pa", "performance": "pp"}), "config")
    by = F.when(F.col("alpha") >= 0.5, F.col("pa")).otherwise(F.col("pp"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("graph", "alpha").orderBy(by, "config"))).drop("pa", "pp")


def random_baseline(df: DataFrame, repeats: int = 100, seed: int = 7) -> DataFrame:
    """One row for each alpha: the metrics' means over ``repeats`` rankings by hash."""
    d = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = d.withColumn("score", hash_uniform(seed, F.col("repeat"), F.col("graph"), F.col("alpha"), F.col("config")))
    d = d.withColumn("graph", F.concat_ws("#", "graph", F.col("repeat").cast("string")))
    return by_alpha(evaluate(ranked(d, "score")))


def recommend_inputs(graphs: DataFrame, conf: DataFrame, alphas: list[float]) -> DataFrame:
    """graphs x configurations x alphas; there are as many configurations as the tuning grid has (27)."""
    return graphs.crossJoin(F.broadcast(conf)).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))


def parameter_ranking(m: DataFrame) -> DataFrame:
    """(graph, config, rank, ...): per graph by F1, NMI, inverse H-norm (each decides before the next), conductance, runtime.

    Rows: graph, config, f1, nmi, inverse_hnorm, conductance, runtime.  A row without a score comes last; ties by configuration.
    """
    score = F.col("f1") * 1_000_000 + F.col("nmi") * 1_000 + F.col("inverse_hnorm") - F.coalesce("conductance", F.lit(0.0)) * 0.001 - F.coalesce("runtime", F.lit(0.0)) * 0.000001
    d = m.withColumn("score", score)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("graph").orderBy(F.desc_nulls_last("score"), "config")))


def average_parameter_rank(r: DataFrame) -> DataFrame:
    return r.groupBy("config").agg(F.avg("rank").alias("avg_rank"), F.median("rank").alias("median_rank"), F.count_if(F.col("rank") == 1).alias("wins"), F.avg("f1").alias("avg_f1"), F.avg("nmi").alias("avg_nmi"), F.avg("runtime").alias("avg_runtime"))


def rank_pivot(r: DataFrame, configs: list[int]) -> DataFrame:
    """graph x configuration -> rank"""
    return r.groupBy("graph").pivot("config", configs).agg(F.first("rank")).withColumnsRenamed({str(c): f"c{c}" for c in configs})


def regression_metrics(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """One row (rmse, mae, r2)."""
    mean = df.agg(F.avg(observed).alias("_mean"))
    e = F.col(observed) - F.col(predicted)
    x = with_totals(df, mean).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"), F.sum(F.pow(F.col(observed) - F.col("_mean"), F.lit(2))).alias("sst"))
    return x.select("rmse", "mae", (1 - F.col("sse") / F.col("sst")).alias("r2"))


def split_graphs(graphs: DataFrame, shares: tuple[float, float, float] = (0.6, 0.1, 0.3), seed: int = 7) -> DataFrame:
    """(graph, part): train, validation, test by the order of md5(seed|graph); graphs, not rows, are split.

    The order needs one row for each graph only; the corpus has some thousands.
    """
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.orderBy(hash_uniform(seed, F.col("graph")), "graph"))
    train, val = F.floor(n * shares[0]), F.floor(n * shares[1])
    return graphs.select("graph").distinct().select("graph", F.when(place <= train, "train").when(place <= train + val, "validation").otherwise("test").alias("part"))


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns scaled to 0..1; 0 where a column doesn't vary."""
    s = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    x = with_totals(df, s)
    out = {c: (F.col(c) - F.col(f"_lo_{c}")) / F.when(F.col(f"_hi_{c}") == F.col(f"_lo_{c}"), 1.0).otherwise(F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c in columns}
    return x.withColumns(out).select(*df.columns)


def coverage(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """One row (marginal, joint, entropy, overall) of how well rows cover the space of columns."""
    b = minmax(df, columns).select(*[F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).alias(c) for c in columns])
    marginal = b.agg(*[(F.count_distinct(c) / bins).alias(c) for c in columns], F.count("*").alias("n"))
    cells = b.groupBy(*columns).agg(F.count("*").alias("k"))
    total = cells.agg(F.sum("k").alias("n"))
    x = with_totals(cells, total).agg(F.count("*").alias("cells"), F.sum(-(F.col("k") / F.col("n")) * F.log(F.col("k") / F.col("n") + 1e-12)).alias("h"))
    y = marginal.crossJoin(x).select((sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)).alias("marginal"), (F.col("cells") / F.least(F.col("n").cast("double"), F.lit(float(bins) ** len(columns)))).alias("joint"), (F.col("h") / F.when(F.col("cells") > 1, F.log("cells")).otherwise(1.0)).alias("entropy"))
    return y.withColumn("overall", 0.5 * F.col("marginal") + 0.3 * F.col("joint") + 0.2 * F.col("entropy"))


def farthest_points(df: DataFrame, key: str, columns: list[str], count: int) -> DataFrame:
    """(key, place): the row farthest from the centre, then each time the row farthest from those chosen; ties by key.

    The chosen points are the state; every round is one pass that keeps a row's least distance so far.
    """
    from .graph import checkpoint

    d = checkpoint(minmax(df.select(key, *columns), columns))
    dist = lambda p: F.sqrt(sum((F.pow(F.col(c) - F.lit(float(v)), F.lit(2)) for c, v in zip(columns, p, strict=True)), F.lit(0.0)))
    state, chosen = d.withColumn("near", dist([0.5] * len(columns))), []
    for place in range(1, count + 1):
        best = state.orderBy(F.desc("near"), key).limit(1).collect()
        if not best:
            break
        chosen.append((best[0][key], place))
        p = dist([best[0][c] for c in columns])
        state = checkpoint(state.where(F.col(key) != best[0][key]).withColumn("near", p if place == 1 else F.least("near", p)))
    return df.sparkSession.createDataFrame(chosen, f"{key} {dict(df.dtypes)[key]}, place int")


def assemble_sweep(edges: DataFrame, parts: DataFrame, runs: DataFrame) -> DataFrame:
    """(graph, config, run, modularity, conductance, inverse_hnorm, teps) of every run of a sweep, all in one job.

    edges(graph, src, dst, w), parts(graph, config, run, v, b) and runs(graph, config, run, runtime in seconds); teps is thousands of
    edge rows a second.  Edges meet each run's labels; what leaves the joins is a row for each pair of blocks.
    """
    keys = ["graph", "config", "run"]
    a, b = parts.select(*keys, F.col("v").alias("src"), F.col("b").alias("r")), parts.select(*keys, F.col("v").alias("dst"), F.col("b").alias("s"))
    pairs = edges.join(a, ["graph", "src"]).join(b, [*keys, "dst"], "left").groupBy(*keys, "r", "s").agg(F.sum("w").alias("m"))
    zero = F.lit(0.0)
    ends = F.array(F.struct(F.col("r").alias("b"), F.col("m").alias("o"), zero.alias("i"), F.when(F.col("r") == F.col("s"), F.col("m")).otherwise(zero).alias("x")), F.struct(F.col("s").alias("b"), zero.alias("o"), F.col("m").alias("i"), zero.alias("x")))
    flows = pairs.select(*keys, F.explode(ends).alias("e")).groupBy(*keys, "e.b").agg(F.sum("e.o").alias("k_out"), F.sum("e.i").alias("k_in"), F.sum("e.x").alias("internal"))
    c = parts.groupBy(*keys, "b").agg(F.count("*").alias("n")).join(flows, [*keys, "b"], "left").fillna(0.0)
    totals = edges.groupBy("graph").agg(F.sum("w").alias("m"), F.count("*").alias("e"))
    c = c.join(totals, "graph")
    q = c.groupBy(*keys).agg(
        F.sum(F.col("internal") / F.col("m") - F.col("k_out") / F.col("m") * (F.col("k_in") / F.col("m"))).alias("modularity"),
        F.avg(F.when(F.col("k_out") > 0, (F.col("k_out") - F.col("internal")) / F.col("k_out")).otherwise(0.0)).alias("conductance"),
        F.sum(log_q_approx(F.floor("internal"), F.col("n"))).alias("parts"),
        F.sum("n").alias("v"),
        F.first("m").alias("m"),
        F.first("e").alias("e"),
    )
    base = log_q_approx(F.floor("m"), F.col("v"))
    return q.join(runs, keys, "left").select(*keys, "modularity", "conductance", F.when(base == 0, 0.0).otherwise(1 - F.col("parts") / base).alias("inverse_hnorm"), (F.col("e") / F.col("runtime") / 1000).alias("teps"))
