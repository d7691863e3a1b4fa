"""Consensus of several annotators' labels (problem 5).

Mean-field variational inference of a confusion model: a Dirichlet prior on the class shares and on each row of each annotator's
confusion matrix. The parameters are a table with a row per annotator and given label and a column per true class. A round joins the
expected log parameters to the labels, adds them up within each item to its class probabilities, and a group-by of annotator and
given label adds these up to the new Dirichlet counts, to which digamma is applied. Neither items nor annotators are collected; only
the class shares, one number a class, come to the driver.

Defined results: abstentions (null, empty, unknown, 255, texts that name no class) take no part; of an annotator's several labels
of an item the latest ``labelled_at`` counts (ties: the larger annotation_id); labels whose item can't be identified are left out;
repeated rows count once; ties of classes go to the lower class; without usable labels there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import cut, drop, salted_join


def clean_path(path: Column) -> Column:
    """A mask path without its mount point, in lower case with single slashes."""
    p = F.lower(F.trim(F.regexp_replace(path, r"[\\/\s]+", "/")))
    return F.regexp_replace(F.regexp_replace(p, r"^.*?(data/)", "$1"), r"/+$", "")


def view_key(scene: Column, stem: Column) -> Column:
    return F.concat_ws("/", F.lower(scene), F.lower(stem))


def label_items(labels: DataFrame, views: DataFrame) -> DataFrame:
    """annotation_id, annotator_id, label, labelled_at of ``labels`` with view_idx: by the mask path, else by scene and file name, else by a file name that only one view has."""
    view = views.where(F.col("view_idx").isNotNull()).groupBy("view_idx").agg(F.max("mask_path").alias("vp"), F.max("name").alias("vn"), F.max("scene").alias("vs"))
    stem = lambda c: F.lower(F.regexp_replace(F.element_at(F.split(F.trim(F.translate(c, "\\", "/")), "/"), -1), r"\.[^.]*$", ""))
    keys = (
        view.select("view_idx", F.concat(F.lit("p:"), clean_path(F.col("vp"))).alias("item_key"))
        .unionByName(view.select("view_idx", F.concat(F.lit("n:"), F.lower("vs"), F.lit("/"), stem(F.col("vn"))).alias("item_key")))
        .unionByName(view.select("view_idx", F.concat(F.lit("s:"), stem(F.col("vn"))).alias("item_key")))
        .where(F.col("item_key").isNotNull())
        .groupBy("item_key")
        .agg(F.min("view_idx").alias("view_idx"), F.max("view_idx").alias("other"))
        .where(F.col("view_idx") == F.col("other"))
        .drop("other")
    )
    name = F.trim(F.translate("view_name", "\\", "/"))
    tries = F.array_compact(
        F.array(
            F.concat(F.lit("p:"), clean_path(F.col("mask_path"))),
            F.when(name.contains("/"), F.concat(F.lit("n:"), F.lower(F.element_at(F.split(name, "/"), -2)), F.lit("/"), stem(F.col("view_name")))),
            F.concat(F.lit("s:"), stem(F.col("view_name"))),
        )
    )
    own = ["annotation_id", "annotator_id", "label", "labelled_at"]
    tried = labels.select(*own, F.posexplode(tries).alias("rank", "item_key"))
    hit = salted_join(tried, keys, ["item_key"])
    # rank and view as one number, so that the least of both is a hash aggregate
    place = F.col("rank").cast("bigint") * (1 << 40) + F.col("view_idx")
    return hit.groupBy(*own).agg(F.min(place).alias("place")).select(*own, F.pmod("place", F.lit(1 << 40)).cast("int").alias("view_idx"))


def usable_labels(labels: DataFrame, views: DataFrame, id2label: DataFrame, unknown: int = 255) -> DataFrame:
    """One row per view and annotator: view_idx, annotator_id, label_id, from texts such as ``facade``, ``01``, ``1:facade``."""
    classes = id2label.where((F.col("id") != unknown) & (F.lower("label") != "unknown"))
    lexicon = classes.select(F.lower(F.trim("label")).alias("word"), F.col("id").alias("label_id")).unionByName(
        classes.select(F.col("id").cast("string").alias("word"), F.col("id").alias("label_id"))
    ).groupBy("word").agg(F.min("label_id").alias("label_id"))
    word = F.lower(F.trim(F.regexp_replace(F.col("label"), r"\s+", " ")))
    first = F.regexp_replace(F.trim(F.split(word, ":")[0]), r"^0+(?=\d)", "")
    item = label_items(labels.where(F.col("annotator_id").isNotNull()), views)
    # the lexicon has two words a class; it grows with the classes, not with the labels
    named = item.withColumn("word", first).join(lexicon, "word").select("view_idx", "annotator_id", "label_id", "labelled_at", "annotation_id")
    return named.groupBy("view_idx", "annotator_id").agg(F.max(F.struct("labelled_at", "annotation_id", "label_id"))["label_id"].alias("label_id"))


def digamma(x: str) -> str:
    """SQL text of the digamma of a positive number: moved up by six, where the asymptotic series holds."""
    y = f"(({x})+6d)"
    terms = "+".join(f"1d/(({x})+{k}d)" for k in range(6))
    return f"(ln({y})-0.5d/{y}-1d/({y}*{y})*({1 / 12}d-1d/({y}*{y})*({1 / 120}d-{1 / 252}d/({y}*{y})))-({terms}))"


#: Rounds of one job. The class shares move once a job: factors of a mean field may be updated in any order.
STEPS = 1


def _digamma(x: np.ndarray) -> np.ndarray:
    """The same for the class shares, one number a class."""
    y = np.asarray(x, dtype=float) + 6
    f = 1 / (y * y)
    return np.log(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f / 252)) - sum(1 / (np.asarray(x, dtype=float) + k) for k in range(6))


@dataclass
class Model:
    """Posterior counts. ``classes`` in order; ``share`` the Dirichlet counts of the classes; ``table`` has annotator_id, j (place of the
    given label) and n0, n1, .. (expected labels of each true class), without priors; ``diagonal`` and ``other`` are the priors."""

    classes: list[int]
    share: np.ndarray
    table: DataFrame
    diagonal: float
    other: float
    rounds: int

    def row_prior(self) -> float:
        return self.diagonal + self.other * (len(self.classes) - 1)


def _probabilities(votes: DataFrame, model: Model, table: DataFrame) -> DataFrame:
    """``votes`` (view_idx, annotator_id, j, m) with q0, q1, .., the class probabilities of their item, given the table's expected log
    parameters, the array l."""
    n = range(len(model.classes))
    table = table.select("annotator_id", "j", "l")
    prior = _digamma(model.share) - _digamma(model.share.sum())
    # an item's labels are at most one of each annotator
    summed = votes.join(table, ["annotator_id", "j"]).selectExpr("view_idx", "annotator_id", "j", "m", *[f"sum(l[{c}]) over (partition by view_idx) as s{c}" for c in n])
    # the prior as an array, which generated code refers to: as numbers in its text they would have each round compiled anew
    added = f"zip_with(array({','.join(f's{c}' for c in n)}), array({','.join(f'{float(x)!r}d' for x in prior)}), (x, y) -> x + y)"
    summed = summed.selectExpr("view_idx", "annotator_id", "j", "m", f"{added} as s").selectExpr("view_idx", "annotator_id", "j", "m", *[f"s[{c}] as s{c}" for c in n])
    top = "greatest(" + ",".join(f"s{c}" for c in n) + ")" if len(n) > 1 else "s0"
    e = summed.selectExpr("*", f"{top} as top").selectExpr("view_idx", "annotator_id", "j", "m", *[f"exp(s{c}-top) as e{c}" for c in n])
    e = e.selectExpr("*", "+".join(f"e{c}" for c in n) + " as norm")
    return e.selectExpr("view_idx", "annotator_id", "j", "m", *[f"e{c}/norm as q{c}" for c in n])


def _counts(now: DataFrame, model: Model) -> DataFrame:
    """The next table: counts n*, their items' share w*, expected log parameters l and mean parameters p."""
    n = range(len(model.classes))
    sums = now.groupBy("annotator_id", "j").agg(*[F.expr(f"sum(q{c}) as n{c}") for c in n], *[F.expr(f"sum(q{c}/m) as w{c}") for c in n])
    # an annotator has a row per class; b is the prior of the cell
    full = sums.selectExpr("*", *[f"sum(n{c}) over (partition by annotator_id) + {model.row_prior()!r}d as t{c}" for c in n])
    cell = lambda c: f"n{c} + if(j = {c}, {model.diagonal!r}d, {model.other!r}d)"
    full = full.selectExpr("annotator_id", "j", *[f"n{c}" for c in n], *[f"w{c}" for c in n], f"array({','.join(cell(c) for c in n)}) as b", f"array({','.join(f't{c}' for c in n)}) as t")
    # arrays keep the generated code small; a row is a handful of numbers
    return full.selectExpr("annotator_id", "j", *[f"n{c}" for c in n], *[f"w{c}" for c in n], f"zip_with(b, t, (x, y) -> {digamma('x')} - {digamma('y')}) as l", "zip_with(b, t, (x, y) -> x / y) as p")


def fit(votes: DataFrame, prior_share: float = 1.0, prior_diagonal: float = 2.0, prior_other: float = 0.5, tol: float = 1e-4, max_rounds: int = 400) -> tuple[Model, DataFrame]:
    """Fit the confusion model to ``votes`` (view_idx, annotator_id, label_id); gives the model and the votes with their item's class
    probabilities. Classes are columns, so they should number at most some hundreds; annotators and items have no bound."""
    spark = votes.sparkSession
    classes = sorted(r[0] for r in votes.select("label_id").distinct().collect())  # the classes
    n = range(len(classes))
    j_code = spark.createDataFrame([(x, i) for i, x in enumerate(classes)], "label_id int, j int")
    coded = votes.join(F.broadcast(j_code), "label_id").select("view_idx", "annotator_id", "j")
    item = Window.partitionBy("view_idx")
    coded = cut(coded.withColumn("m", F.count("*").over(item)))
    empty = spark.createDataFrame([], "annotator_id int, j int")
    model = Model(classes, np.full(len(classes), prior_share), empty, prior_diagonal, prior_other, 0)
    # start: each item's class probabilities are its shares of votes
    now = coded.select("*", *[(F.sum((F.col("j") == c).cast("double")).over(item) / F.col("m")).alias(f"q{c}") for c in n])
    table = model.table
    while classes:
        for _ in range(STEPS):
            table = _counts(now, model)
            now = _probabilities(coded, model, table)
        if model.rounds:
            before = model.table.selectExpr("annotator_id", "j", "p as o")
            gap = "array_max(zip_with(p, o, (x, y) -> abs(x - y))) as moved"
            table = table.join(before, ["annotator_id", "j"], "left").selectExpr("annotator_id", "j", *[f"{x}{c}" for x in "nw" for c in n], "l", "p", gap)
        else:
            table = table.withColumn("moved", F.lit(1.0))
        table = cut(table)
        got = table.agg(F.max("moved"), *[F.sum(f"w{c}") for c in n]).first()  # one number a class
        drop(model.table)
        model.table, model.share, model.rounds = table, prior_share + np.array(got[1:], dtype=float), model.rounds + STEPS
        now = _probabilities(coded, model, table)
        if got[0] < tol or model.rounds >= max_rounds:
            break
    return model, now


def consensus(now: DataFrame, model: Model) -> DataFrame:
    """Per view: label_id, its probability, votes, and the share of votes that agree with it."""
    n = range(len(model.classes))
    q = F.array(*[F.col(f"q{c}") for c in n]) if len(n) else F.array().cast("array<double>")
    classes = F.array(*[F.lit(int(c)) for c in model.classes]) if len(n) else F.array().cast("array<int>")
    best = now.select("view_idx", "j", "m", F.array_max(q).alias("p"), (F.array_position(q, F.array_max(q)) - 1).cast("int").alias("c"))
    one = best.groupBy("view_idx", "c").agg(F.max("p").alias("probability"), F.count("*").alias("n_votes"), F.avg((F.col("j") == F.col("c")).cast("double")).alias("agreement"))
    return one.select("view_idx", F.get(classes, F.col("c")).alias("label_id"), "probability", F.col("n_votes").cast("int").alias("n_votes"), "agreement")


def reliability(model: Model, level: float = 0.9, draws: int = 4000) -> DataFrame:
    """Per annotator: posterior mean reliability (accuracy over the class shares) with an equal-tailed interval of the posterior.

    The accuracy is a weighted sum of independent Beta variables, one a class; its quantiles are those of ``draws`` draws, seeded by the
    annotator, so they are the same in every run.
    """
    n = range(len(model.classes))
    if not len(n):
        return model.table.sparkSession.createDataFrame([], "annotator_id int, reliability double, low double, high double, n_labels double")
    weight = model.share / model.share.sum()
    hit = [F.sum(F.when(F.col("j") == c, F.col(f"n{c}")).otherwise(0.0)) for c in n]
    per = model.table.groupBy("annotator_id").agg(F.array(*hit).alias("hit"), F.array(*[F.sum(f"n{c}") for c in n]).alias("all"))
    diagonal, row = model.diagonal, model.row_prior()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for who, h, t in zip(b["annotator_id"], b["hit"], b["all"]):
                a, total = np.asarray(h, dtype=float) + diagonal, np.asarray(t, dtype=float) + row
                rest = np.maximum(total - a, 1e-9)
                sample = np.random.default_rng(abs(int(who))).beta(a, rest, size=(draws, len(a))) @ weight
                low, high = np.quantile(sample, [(1 - level) / 2, (1 + level) / 2])
                rows.append((who, float(a / (a + rest) @ weight), float(low), float(high), float(np.asarray(t, dtype=float).sum())))
            yield pd.DataFrame(rows, columns=["annotator_id", "reliability", "low", "high", "n_labels"])

    return per.mapInPandas(run, "annotator_id int, reliability double, low double, high double, n_labels double")


def krippendorff(votes: DataFrame) -> DataFrame:
    """Krippendorff's alpha for nominal labels: one row with alpha, n_items (with two votes or more) and n_votes; null alpha if undefined."""
    per = votes.groupBy("view_idx", "label_id").agg(F.count("*").alias("n"))
    m = Window.partitionBy("view_idx")
    pairable = per.withColumn("m", F.sum("n").over(m)).where(F.col("m") >= 2)
    by_label = pairable.groupBy("label_id").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / (F.col("m") - 1)).alias("agree"), F.sum(F.col("n") / F.col("m")).alias("items")
    )
    total = by_label.agg(F.sum("n").alias("t"), F.sum("agree").alias("o"), F.sum(F.col("n") * (F.col("n") - 1)).alias("e"), F.sum("items").alias("items"))
    observed = 1 - F.col("o") / F.col("t")
    expected = 1 - F.col("e") / (F.col("t") * (F.col("t") - 1))
    return total.where(F.col("t") > 1).select(
        F.when(expected > 0, 1 - observed / expected).alias("alpha"), F.round("items").cast("bigint").alias("n_items"), F.col("t").alias("n_votes")
    )
