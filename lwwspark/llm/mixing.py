"""Mixing by soft membership: rates for documents so that expected domain totals match target weights.

A naive Bayes classifier, learned from a table that labels some documents with a domain, gives each document posteriors p
over the domains. Words that tell domains apart by a test of proportions (``terms`` at most) each speak for one domain; the
evidence that a document's terms give for a domain has one of four levels, and the levels' frequencies are learned; a
document of n tokens counts n * p tokens towards them. Then projected gradient
descent (accelerated, restarted when it stops helping) minimises the squared distance of the domains' expected totals
from their targets, weighted by the inverse Gram matrix of the posteriors, over nonnegative rates, starting from 1 for
every document. Each step sums K numbers over the table and moves every rate by its posteriors' share of the gradient.

Tokens are what the pattern of the public byte-level vocabularies cuts a text into (words with the blank before them,
numbers, runs of signs, white space), counted by the regular expression itself; or the caller's own, from a column.

DataFrame functions only: terms are found by a set intersection inside the row, so texts are neither exploded nor shuffled
(but for the sample that the classifier learns from); steps run over a narrow table; the driver sees K sums a
step and the terms with their counts.

Fitting uses at most about ``labelled_rows`` labelled rows, those with the smallest hashes of their ids, and the ``terms``
best words among those that ``least`` of these rows have; all three are parameters. Posteriors, tokens and sums are taken
over all rows and whole texts.

Defined results: null and empty texts have 0 tokens and the domains' prior as posteriors. Labels with a null id or a
domain that has no target don't count; without any label the posteriors are uniform. Rows are judged one by one, so
repeated rows get equal rates. If nothing has tokens, rates are 1. Targets that can't be reached are approached as far as
least squares goes. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, fresh

#: The bounds of the fit, and of the descent: steps, and how near the targets is near enough.
TERMS, LEAST, LABELLED = 512, 5, 12_000
STEPS, NEAR = 60, 1e-4
#: The pattern of the public byte-level vocabularies. Fixed value.
TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SURE, STRONG = 4.0, 3.0  # standard deviations, and times as often as in the first domain, for a word to be a term
GRADES = (3.0, 8.0)  # bounds of evidence between levels


def words_of(text: Column) -> Column:
    """Words between blanks and line ends; none for null and empty texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \n]"), "")


def tokens_of(text: Column) -> Column:
    """Number of tokens; 0 for null and empty texts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


def literal(values, digits: str = ".4f") -> Column:
    """A constant array; folded once when the plan is made."""
    return F.split(F.lit(",".join(format(float(v), digits) for v in values)), ",").cast("array<double>")


@dataclass
class Judge:
    """Terms; by domain but the first, how much each of its terms speaks for it (0 for other domains' terms); and log prior
    and log chances of each level of evidence, by domain."""

    terms: list[str]
    weights: np.ndarray  # domains - 1, terms
    prior: np.ndarray
    chances: np.ndarray | None = None  # domain, domain that the evidence is for, level

    def levels(self, words: Column) -> Column:
        """Array of levels, 1 (no term) to 4, of the evidence for each domain but the first."""
        terms = F.array(*(F.lit(t) for t in self.terms)) if self.terms else F.array().cast("array<string>")
        at = F.transform(F.array_intersect(words, terms), lambda w: F.array_position(terms, w).cast("int"))
        sums = lambda table: F.aggregate(at, F.lit(0.0), lambda s, i: s + F.element_at(table, i))
        grade = lambda e: F.when(e == 0, 1).when(e < GRADES[0], 2).when(e < GRADES[1], 3).otherwise(4)
        return F.transform(F.array(*(sums(literal(w)) for w in self.weights)), grade) if self.terms else F.array(*(F.lit(1) for _ in self.weights))

    def logits(self, levels: Column) -> Column:
        """Array of log posteriors, not yet normalised."""
        out = []
        for j, prior in enumerate(self.prior):
            total = F.lit(float(prior))
            for i in range(len(self.weights)):
                total = total + F.element_at(literal(self.chances[j, i]), F.element_at(levels, i + 1))
            out.append(total)
        return F.array(*out)


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], doc_id: str, text: str, terms: int = TERMS, least: int = LEAST, labelled_rows: int = LABELLED) -> Judge:
    """Fits the classifier. A document counts a word once; the words whose presence tells most become terms."""
    k = len(domains)
    order = F.xxhash64("id").cast("double")
    known = labelled.select(F.col(doc_id).alias("id"), F.col("domain")).where(F.col("id").isNotNull() & F.col("domain").isin(domains)).distinct()
    n = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    prior = np.log([(n.get(d, 0) + 1) / (total + k) for d in domains])
    reach = F.lit(-(2.0**63) + 2.0**64 * min(1.0, labelled_rows / max(1, total)))
    chosen = F.broadcast(known.where(order <= reach))  # about labelled_rows ids: a broadcast of bounded size
    rows = docs.select(F.col(doc_id).alias("of"), F.col(text).alias("text")).join(chosen, F.col("of") == F.col("id"))
    size = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    sizes = [size.get(d, 0) for d in domains]
    if not sum(sizes):
        return Judge([], np.zeros((k - 1, 0)), prior, np.zeros((k, k - 1, 4)))
    words = rows.select("domain", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    in_each = [F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)]
    counts = words.groupBy("word").agg(F.count("*").alias("n"), *in_each)
    share, tells = F.col("n") / sum(sizes), []
    for i in range(1, k):
        by_chance = share * sizes[i]
        sure = (F.col(f"n{i}") - by_chance) / F.sqrt(by_chance * (1 - share) + 1e-9)
        times = ((F.col(f"n{i}") + 0.5) / (sizes[i] + 1)) / ((F.col("n0") + 0.5) / (sizes[0] + 1))
        tells.append(F.when(times >= STRONG, sure))
    counts = counts.withColumn("tells", F.array_max(F.array(F.lit(0.0), *tells)))
    best = counts.where((F.col("n") >= least) & (F.col("tells") >= SURE)).orderBy(F.desc("tells"), "word").limit(terms).collect()
    at = np.array([[r[f"n{i}"] for r in best] for i in range(k)], float).reshape(k, len(best))
    odds = np.log((at + 0.5) / (np.array(sizes)[:, None] + 1))
    odds = (odds - odds[0])[1:]
    weights = np.where(odds == odds.max(axis=0), np.maximum(odds, 0), 0) if len(best) and k > 1 else np.zeros((k - 1, len(best)))
    judge = Judge([r["word"] for r in best], weights, prior)
    graded = rows.select("domain", judge.levels(words_of(F.col("text"))).alias("levels")).select("domain", F.posexplode("levels").alias("of", "level"))
    seen = np.full((k, k - 1, 4), 0.5)
    for r in graded.groupBy("domain", "of", "level").agg(F.count("*").alias("n")).collect():
        seen[domains.index(r["domain"]), r["of"], r["level"] - 1] += r["n"]
    judge.chances = np.log(seen / seen.sum(axis=2, keepdims=True))
    return judge


def _softmax(rows: DataFrame, logits: str, out: list[str]) -> DataFrame:
    top = F.array_max(logits)
    parts = [F.exp(F.element_at(logits, i + 1) - top) for i in range(len(out))]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return rows.withColumns({c: p / total for c, p in zip(out, parts, strict=True)})


def stepped(rows: DataFrame, p: list[str], steps: list[tuple[np.ndarray, float]]) -> DataFrame:
    """Columns rate and lead after further steps (gradient by domain, momentum), as one fold in the row."""
    k = len(p)
    if not steps:
        return rows
    flat = literal([x for gradient, momentum in steps for x in (*gradient, momentum)], ".17g")

    def step(s, t):
        at = lambda j: F.element_at(flat, t * (k + 1) + j + 1)
        move = F.col(p[0]) * at(0)
        for j in range(1, k):
            move = move + F.col(p[j]) * at(j)
        new = F.greatest(F.lit(0.0), s["lead"] - move)
        return F.struct(new.alias("rate"), (new + (new - s["rate"]) * at(k)).alias("lead"))

    folded = F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.struct("rate", "lead"), step)
    return rows.withColumn("state", folded).withColumns({"rate": F.col("state.rate"), "lead": F.col("state.lead")}).drop("state")


def solve(table: DataFrame, p: list[str], words: str, goal: np.ndarray) -> DataFrame:
    """Runs the descent over a narrow table (words, p...); ``goal``: each domain's share. Adds column rate."""
    k = len(p)
    weighted = lambda c: F.sum(F.col(words) * c)
    first = table.agg(*(weighted(F.col(a) * F.col(b)) for a in p for b in p), F.sum(words)).first()
    total = float(first[-1] or 0)
    state = table.withColumns({"rate": F.lit(1.0), "lead": F.lit(1.0)})
    if not total:
        return state.drop("lead")
    # Distances between totals are taken in the metric of the inverse Gram matrix of the posteriors: the same rates reach
    # targets that can be reached, and where no rate is held at zero one step of length one gets there.
    gram = np.array(first[:-1], float).reshape(k, k) / total
    metric = np.linalg.inv(gram + 1e-3 * np.trace(gram) * np.eye(k))
    age, before, pending, seen = 1.0, math.inf, [], []
    for step in range(STEPS):
        sums = stepped(state, p, pending).agg(*(weighted(F.col("lead") * F.col(c)) for c in p)).first()
        gap = np.array(sums, float) / total - goal
        error = float(np.abs(gap).max())
        seen.append(error)
        if error < NEAR or len(seen) > 5 and error > 0.99 * seen[-6]:  # there, or as far as least squares goes
            # The rates themselves, not the points they lead to, must be near: take the lead as the last step.
            pending.append((np.zeros(k), 0.0))
            break
        if error > before:
            age = 1.0
        new = (1 + math.sqrt(1 + 4 * age * age)) / 2
        pending.append((metric @ gap, (age - 1) / new))
        age, before = new, error
        if len(pending) == 12 and step < STEPS - 1:
            older, state, pending = state, cut(stepped(state, p, pending)), []
            forget(older)
    return stepped(state, p, pending).drop("lead")


def goal_of(targets: Mapping[str, float]) -> tuple[list[str], np.ndarray]:
    domains = sorted(targets)
    weights = np.array([targets[d] for d in domains], float)
    if not len(domains) or (weights < 0).any() or not weights.sum():
        raise ValueError("targets must be nonnegative and not all zero")
    return domains, weights / weights.sum()


def copies_of(rate: Column, key: Column) -> Column:
    """Whole copies: the rate's floor, and one more for the share of documents (by hash) that its fraction says."""
    draw = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def rated(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], doc_id: str, text: str, tokens: str | None = None, **bounds) -> tuple[list[str], DataFrame]:
    """(posterior columns; doc_id, text_hash, n_tokens, posteriors, rate of every document)."""
    domains, goal = goal_of(targets)
    judge = learn(docs, labelled, domains, doc_id, text, **bounds)
    p = [f"p{i}" for i in range(len(domains))]
    n = F.coalesce(F.col(tokens).cast("bigint"), F.lit(0).cast("bigint")) if tokens else tokens_of(F.col(text)).cast("bigint")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), n.alias("n_tokens"), words_of(F.col(text)).alias("words"))
    rows = rows.select("doc_id", "text_hash", "n_tokens", judge.levels(F.col("words")).alias("levels"))
    rows = rows.select("doc_id", "text_hash", "n_tokens", judge.logits(F.col("levels")).alias("logits"))
    table = cut(_softmax(rows, "logits", p).drop("logits"))
    return p, solve(table, p, "n_tokens", goal)


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], doc_id: str = "doc_id", text: str = "text", tokens: str | None = None, **bounds) -> DataFrame:
    """doc_id, n_tokens, posteriors (by domain name, sorted), rate, copies for every document.

    ``labelled``: doc_id and domain. ``targets``: the weight of each domain in the mixture, which has as many tokens as
    docs. ``tokens``: a column of docs that has their numbers. ``bounds``: terms, least, labelled_rows.
    """
    p, rows = rated(docs, labelled, targets, doc_id, text, tokens, **bounds)
    return rows.select("doc_id", "n_tokens", F.array(*p).alias("posteriors"), "rate", copies_of(F.col("rate"), F.col("doc_id")).alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float]) -> DataFrame:
    """The documents, each as often as its copies say. Columns stay."""
    of, text_hash, copies, each = (fresh(docs, f"mix_{c}") for c in ("id", "hash", "copies", "copy"))
    rows = rated(docs, labelled, targets, "doc_id", "text")[1]
    # Copies follow from id and text, so repeated rows share an entry.
    found = rows.select(F.col("doc_id").alias(of), F.col("text_hash").alias(text_hash), copies_of(F.col("rate"), F.col("doc_id")).alias(copies))
    found = cut(found.groupBy(of, text_hash).agg(F.max(copies).alias(copies)))
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(text_hash))
    kept = docs.join(found.where(F.col(copies) > 0), same)
    return kept.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))


#: Production parameters.
TARGETS = {"clean": 0.90, "low": 0.06, "toxic": 0.04}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain: toxic documents, then low quality, then clean ones; unknown where both labels are null."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")
