"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a sample of its labelled text. A document is parsed greedily into the
longest phrases that occur in that text; the language that needs the fewest phrases, normalised to bits a character
(phrases x log2 of the sample's length / characters), wins.

Greedy parsing with a suffix automaton is itself a finite automaton: where no transition exists, a phrase ends and the
walk goes on with the root's transition. Transitions are kept by row displacement: all states' rows overlaid in one array
without collisions, so a table is as large as its transitions are many, whatever the alphabet. A whole batch of documents
is walked at once, in segments of ``SEGMENT`` characters, one step for all of them. Where a segment begins is no place
where a phrase must end: each segment is then walked once more from the state in which the one before it really ends,
until both walks meet, and counted anew up to there. So the counts are those of whole texts.

Case doesn't count, and any run of characters that aren't letters counts as one separator, so what junk a text holds says
nothing about its language. A letter that a sample lacks is a phrase of its own.

Fitting: the sample of a language is ``SAMPLE_PIECES`` passages of ``PIECE`` characters, those with the smallest hashes
among all passages of all its learning texts (many documents, so that no single one stamps it). Only these bounded samples
are collected or sent to executors, of ``LANGUAGES`` languages at most; more are an error, as every worker holds a table
for each. Rows whose crc32(id) mod 4 is 2, or whose id, language or text is null, are never learned from. Scoring reads
texts whole and has no shuffle.

Defined results: null texts, empty texts and texts without a letter get ``und`` and 0; so do all if nothing can be
learned. Ties go to the language that sorts first. Repeated rows get equal results. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_small_batches, fold_of, fresh

#: The bounds of the fit: passages of a language, characters of a passage, languages.
SAMPLE_PIECES, PIECE, LANGUAGES = 128, 250, 2000
SEGMENT = 256
#: States that a batch's walk keeps at a time.
HELD = 1 << 22


def learn_samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", pieces: int = SAMPLE_PIECES, piece: int = PIECE) -> dict[str, str]:
    """Bounded training text for each language."""
    spark = docs.sparkSession
    rows = docs.where((fold_of(doc_id, 4) != 2) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    n = F.ceil(F.length("text") / piece)
    totals = rows.groupBy("lang").agg(F.sum(n).alias("n")).limit(LANGUAGES + 1).collect()
    if len(totals) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    # Hashes are even: below this bound lie about four times as many passages as are wanted, of each language.
    reach = [(r["lang"], -(2.0**63) + 2.0**64 * min(1.0, 4 * pieces / r["n"])) for r in totals if r["n"]]
    if not reach:
        return {}
    bounds = F.broadcast(spark.createDataFrame(reach, "lang string, reach double"))  # a row for each language
    order = lambda at: F.xxhash64("id", at)
    near = F.filter(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda at: order(at).cast("double") <= F.col("reach"))
    cut_out = rows.where("text <> ''").join(bounds, "lang").select("lang", "id", "text", F.explode(near).alias("at"))
    cut_out = cut_out.select("lang", order(F.col("at")).alias("order"), F.substring("text", (F.col("at") * piece + 1).cast("int"), F.lit(piece)).alias("text"))
    first = Window.partitionBy("lang").orderBy("order", "text")
    best = cut_out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= pieces)
    texts: dict[str, list] = {}
    for r in best.select("lang", "rank", "text").collect():
        texts.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    return {k: "\n".join(t for _, t in sorted(v)) for k, v in sorted(texts.items())}


def suffix_automaton(codes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``codes``; state 0 is the root."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new, p = len(go), last
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


def displaced(go: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, target): state s has a transition by c to target[base[s] + c] where owner[base[s] + c] is s.

    States with several transitions are laid first fit, those with one fill what is left free. Codes are below ``width``.
    """
    many = sorted((s for s, t in enumerate(go) if len(t) > 1), key=lambda s: (-len(go[s]), s))
    single = [s for s, t in enumerate(go) if len(t) == 1]
    size = 2 * width + 2 * sum(len(go[s]) for s in many) + len(single)
    taken, base, low = bytearray(size), [width] * len(go), width
    for s in many:
        codes = sorted(go[s])
        while taken[low]:
            low += 1
        at, tries = low, 0
        while taken[at] or any(taken[at + c - codes[0]] for c in codes[1:]):
            at, tries = at + 1, tries + 1
            if at + width >= len(taken):
                taken.extend(bytes(width + len(taken)))
        if tries > 64:  # what lies lower is too crowded for rows like this one; single transitions will fill it
            low = max(low, at - 64)
        base[s] = at - codes[0]
        for c in codes:
            taken[base[s] + c] = 1
    free = np.flatnonzero(np.frombuffer(taken, np.uint8)[width:] == 0) + width
    if len(free) < len(single):
        free = np.concatenate([free, np.arange(len(single) - len(free)) + len(taken)])
    for s, at in zip(single, free.tolist(), strict=False):
        base[s] = at - next(iter(go[s]))
    end = max((base[s] for s in range(len(go))), default=0) + width
    owner, target = np.full(end, -1, np.int64), np.zeros(end, np.int64)
    for s in [*many, *single]:
        for c, to in go[s].items():
            owner[base[s] + c], target[base[s] + c] = s, to
    return np.array(base, np.int64), owner, target


class CrossParser:
    """Phrase counts of texts against every language's sample."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letters = sorted({c for t in samples.values() for c in t.lower() if c.isalpha()})
        width = len(letters) + 2  # code 0: letters that no sample has; 1: what isn't a letter
        self.code = np.fromiter((not chr(i).isalpha() for i in range(0x110000)), np.int32, 0x110000)
        for i, c in enumerate(letters, 2):
            for form in {c, c.upper()}:
                if len(form) == 1:
                    self.code[ord(form)] = i
        parts, self.bits = [], []
        self.begin = np.zeros((len(self.langs), width), np.int64)  # the state after a phrase's first character
        states = places = 0
        for k, lang in enumerate(self.langs):
            codes, _ = self.codes([samples[lang]])
            # One more state: after a character that the sample lacks.
            go = [*suffix_automaton(codes.tolist()), {}]
            base, owner, target = displaced(go, width)
            self.begin[k] = states + len(go) - 1
            for c, to in go[0].items():
                self.begin[k, c] = states + to
            parts.append((base + places, np.where(owner < 0, -1, owner + states), target + states))
            self.bits.append(np.log2(max(2, len(codes))))
            states, places = states + len(go), places + len(owner)
        kind = np.int32 if max(states, places) < 2**31 else np.int64
        self.base, self.owner, self.target = (np.concatenate(c).astype(kind) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, kind),) * 3
        self.begin, self.bits = self.begin.astype(kind), np.array(self.bits)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts together, runs of separators as one, and each text's number of them."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1)
        keep[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return codes[keep], np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each text, none empty, in each language; its characters)."""
        codes, lengths = self.codes(texts)
        lanes = -(-lengths // SEGMENT)
        first = np.cumsum(lanes) - lanes
        nth = np.arange(lanes.sum()) - np.repeat(first, lanes)
        start = np.repeat(np.cumsum(lengths) - lengths, lanes) + nth * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(lengths, lanes) - nth * SEGMENT)
        counts = np.empty((len(self.langs), len(size)), np.int64)
        most, carry = max(1, HELD // (SEGMENT * max(1, len(self.langs)))), self.begin[:, 0]
        for a in range(0, len(size), most):
            part = slice(a, a + most)
            counts[:, part], carry = self._walk(codes, start[part], size[part], nth[part] > 0, carry)
        return np.add.reduceat(counts, first, axis=1).T + 1, lengths

    def _step(self, state: np.ndarray, code: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after a character, whether a phrase ended before it). ``fresh``: the states if one did."""
        at = self.base.take(state)
        at += code
        ended = self.owner.take(at) != state
        go = self.target.take(at)
        np.copyto(go, fresh, where=ended)
        return go, ended

    def _walk(self, codes, start, size, goes_on, carry) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that end inside each segment, by language; the states at the last one's end).

        ``goes_on``: whether a segment continues the one before it; ``carry``: the states in which the one before the first ends.
        """
        order = np.argsort(-size, kind="stable")
        from_, long = start[order], size[order]
        alive = np.searchsorted(-long, -np.arange(1, long[0] + 1), side="right")
        state = self.begin[:, codes[from_]]
        trace = np.empty((long[0], *state.shape), state.dtype)
        breaks = np.zeros(trace.shape, bool)  # where a phrase ended before the character
        trace[0] = state
        for t in range(1, long[0]):
            n = alive[t]
            code = codes[from_[:n] + t]
            go, new = self._step(state[:, :n], code, self.begin.take(code, axis=1))
            state[:, :n] = trace[t, :, :n] = go
            breaks[t, :, :n] = new
        ended = breaks.sum(axis=0, dtype=np.int64)
        lane = np.empty(len(order), np.int64)  # a segment's place in the trace
        lane[order] = np.arange(len(order))
        alone = state[:, lane]  # the states at the ends of segments that are walked from their own beginnings
        ends, more = alone.copy(), np.zeros((len(self.langs), len(order)), np.int64)
        # Once more from where the segments before really end, until both walks are in one state.
        lang, seg = np.nonzero(np.broadcast_to(goes_on, ends.shape))
        while len(seg):
            now = np.where(seg > 0, ends[lang, seg - 1], carry[lang])
            l, s, t = lang, seg, 0
            gained, changed_l, changed_s = np.zeros(len(seg), np.int64), [], []
            place = np.arange(len(seg))
            while len(s):
                code = codes[start[s] + t]
                go, new = self._step(now, code, self.begin[l, code])
                gained[place] += new.astype(np.int64) - breaks[t, l, lane[s]]
                apart = go != trace[t, l, lane[s]]
                done = ~apart | (size[s] == t + 1)
                end = np.where(apart, go, alone[l, s])
                differs = done & (ends[l, s] != end)  # the next segment begins in another state
                ends[l[differs], s[differs]] = end[differs]
                changed_l.append(l[differs])
                changed_s.append(s[differs])
                stay = ~done
                l, s, now, place, t = l[stay], s[stay], go[stay], place[stay], t + 1
            more[lang, seg] = gained
            lang, seg = np.concatenate(changed_l), np.concatenate(changed_s) + 1
            on = seg < len(size)
            lang, seg = lang[on], seg[on]
            on = goes_on[seg]
            lang, seg = lang[on], seg[on]
        return ended[:, lane] + more, ends[:, -1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        if at:
            counts, n = self.phrases([texts[i] for i in at])
            bits = counts * self.bits / n[:, None]
            best = bits.argmin(axis=1)
            sharp = np.minimum(n, 64)[:, None] * (bits - bits[np.arange(len(at)), best][:, None])
            scores[at] = 1 / np.exp2(-np.minimum(sharp, 500)).sum(axis=1)
            for i, k in zip(at, best, strict=True):
                langs[i] = self.langs[k]
        return langs, scores


_KEPT: dict[tuple, CrossParser] = {}


def parser(samples: dict[str, str]) -> CrossParser:
    """Built once in each Python worker."""
    key = tuple(sorted(samples.items()))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = CrossParser(samples)
    return _KEPT[key]


def chunks(texts: list, most: int = 1 << 22):
    """Slices of a batch with about ``most`` characters each."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def language_of(samples: dict[str, str], text):
    """struct<lang_pred, score> of a text column."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(batch: pa.Array) -> pa.Array:
        texts, langs, scores = batch.to_pylist(), [], [np.zeros(0)]
        for a, b in chunks(texts):
            got = parser(samples).predict(texts[a:b])
            langs += got[0]
            scores.append(got[1])
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"])

    return predict(text)


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    samples = learn_samples(docs, doc_id, text, lang)
    out = by_small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.coalesce(fold_of(doc_id, 4) == 2, F.lit(False)).alias("held_out"), language_of(samples, F.col(text)).alias("x"))
    return out.select("doc_id", "held_out", "x.lang_pred", "x.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told; rejected are those with ``und``. Columns stay."""
    mark = fresh(docs, "identified")
    marked = by_small_batches(docs).withColumn(mark, language_of(learn_samples(docs), F.col("text")))
    return marked.where(F.col(f"`{mark}`.lang_pred") != "und").drop(mark)
