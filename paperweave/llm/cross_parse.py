"""Operator 9: language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperweave.llm.common import fold_of, give_back, small_batches, table

SAMPLE_DOCS = 96
CHARS_PER_DOC = 168
CHUNK = 512
COLUMNS = 64
TASKS_AT_ONCE = 64
PAD, GAP, OTHER = 0, 1, 2
COUNT_SHIFT = 24
BATCH_CHARS = 2_000_000


def _plain(text: str) -> str:
    """Lower-case letters, every run of anything else one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the minimal automaton of all substrings of `text`; state 0 is the root."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        state = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[state] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = state
    return step


def _edges(sample: pd.DataFrame) -> pd.DataFrame:
    """One language's automaton as a row per transition."""
    texts = [_plain(t)[:CHARS_PER_DOC] for t in sample.sort_values(["rank", "text"])["text"]]
    model = " " + " ".join(texts) + " "
    step = suffix_automaton(model)
    rows = [(s, c, t) for s, out in enumerate(step) for c, t in out.items()]
    frame = pd.DataFrame(rows, columns=["state", "symbol", "target"])
    frame.insert(0, "lang", sample["lang"].iloc[0])
    return frame.assign(symbols=len(model))


class Parser:
    """Automata over one shared alphabet; counts the phrases a text needs in each language.

    The alphabet holds every letter of every automaton. Steps by its commonest
    letters, the first COLUMNS codes, stand in dense tables; steps by the others
    are sorted keys of state and code. Only letters that no automaton knows are OTHER.
    """

    def __init__(self, edges: pd.DataFrame):
        self.langs = sorted(edges["lang"].unique())
        common = [c for c, _ in sorted(Counter(edges["symbol"]).items(), key=lambda x: (-x[1], x[0])) if c != " "]
        self.letters = common
        self.kind = next(t for t in (np.uint8, np.uint16, np.int32) if len(common) + 3 <= np.iinfo(t).max)
        code = {c: i + 3 for i, c in enumerate(self.letters)} | {" ": GAP}
        self.tables, self.rare = [], []
        # A phrase found in a longer model names a place in it at a higher cost: its logarithm in symbols.
        self.cost = np.array([np.log2(edges.loc[edges["lang"] == lang, "symbols"].iloc[0]) for lang in self.langs])
        for lang in self.langs:
            own = edges[edges["lang"] == lang]
            n = int(own["target"].max()) + 1
            step = np.full((n, COLUMNS), -1, np.int32)
            state, codes, target = own["state"].to_numpy(np.int64), own["symbol"].map(code).to_numpy(np.int64), own["target"].to_numpy(np.int32)
            dense = codes < COLUMNS
            step[state[dense], codes[dense]] = target[dense]
            self.tables.append(self._counted(step).ravel())
            self.rare.append(self._sparse(state[~dense], codes[~dense], target[~dense]))

    def _sparse(self, state: np.ndarray, codes: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, next states, next state from the root per code) of steps by letters beyond the dense tables."""
        root = np.full(max(0, len(self.letters) + 3 - COLUMNS), 1 << COUNT_SHIFT, np.int32)
        root[codes[state == 0] - COLUMNS] = target[state == 0]
        keys = state * (len(self.letters) + 3) + codes
        order = np.argsort(keys)
        return keys[order], target[order], root

    def _rare_step(self, k: int, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states, with the phrases that end on the way, as in the dense tables."""
        keys, target, root = self.rare[k]
        out = root[codes - COLUMNS] + np.where(state > 0, np.int32(1 << COUNT_SHIFT), np.int32(0))
        if len(keys):
            key = state.astype(np.int64) * (len(self.letters) + 3) + codes
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out = np.where(keys[at] == key, target[at], out)
        return out

    @staticmethod
    def _counted(step: np.ndarray) -> np.ndarray:
        """Next state, with the number of phrases that end on the way in the high bits."""
        root = step[0].copy()
        lost = root < 0
        restart = np.where(lost, 1 << COUNT_SHIFT, root)
        out = np.where(step < 0, restart + (1 << COUNT_SHIFT), step)
        out[0] = restart
        out[:, PAD] = 1 << COUNT_SHIFT
        out[0, PAD] = 0
        return out.astype(np.int32)

    def _codes(self) -> np.ndarray:
        """Code of every Unicode code point; anything but a letter is a gap."""
        lut = np.full(0x110000, GAP, self.kind)
        lut[[i for i in range(0x110000) if chr(i).isalpha()]] = OTHER
        for i, c in enumerate(self.letters):
            lut[ord(c)] = i + 3
        return lut

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases per text and language, symbols per text, letters per text) of whole texts.

        Texts are cut into chunks of CHUNK symbols that are parsed in lockstep;
        a phrase ends with its chunk, in all languages alike.
        """
        if not hasattr(self, "lut"):
            self.lut = self._codes()
        parts = [self.lut[np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)] for t in texts]
        letters = np.array([int((p >= OTHER).sum()) for p in parts])
        parts = [p[(p != GAP) | (np.concatenate(([GAP], p[:-1])) != GAP)] if len(p) else p for p in parts]
        size = np.array([len(p) for p in parts])
        chunks = -(-size // CHUNK)
        owner = np.repeat(np.arange(len(parts)), chunks)
        first = np.concatenate(([0], np.cumsum(chunks)))[:-1]
        grid = np.zeros((int(chunks.sum()), CHUNK + 1), self.kind)
        for p, at, n in zip(parts, first, chunks):
            for k in range(n):
                piece = p[k * CHUNK:(k + 1) * CHUNK]
                grid[at + k, : len(piece)] = piece
        grid = np.ascontiguousarray(grid.T)
        rare = [()] * len(grid)
        if len(self.letters) + 3 > COLUMNS:
            rare = [(at, row[at].astype(np.int64)) if len(at := np.flatnonzero(row >= COLUMNS)) else () for row in grid]
            grid[grid >= COLUMNS] = OTHER
        found = np.zeros((len(parts), len(self.langs)))
        mask = (1 << COUNT_SHIFT) - 1
        for k, moves in enumerate(self.tables):
            state = np.zeros(grid.shape[1], np.int32)
            count = np.zeros(grid.shape[1], np.int32)
            for symbols, others in zip(grid, rare):
                before, state = state, moves[(state << 6) + symbols]
                if others:
                    state[others[0]] = self._rare_step(k, before[others[0]], others[1])
                count += state >> COUNT_SHIFT
                state &= mask
            found[:, k] = np.bincount(owner, weights=count, minlength=len(parts))
        return found, size, letters

    def judge(self, texts: list[str | None]) -> pd.DataFrame:
        """(lang_pred, score, phrase_length) per text."""
        out = pd.DataFrame({"lang_pred": "und", "score": 0.0, "phrase_length": 0.0}, index=range(len(texts)))
        if not self.langs or not texts:
            return out
        found, size, letters = self.phrases([t or "" for t in texts])
        bits = found * self.cost
        best = bits.argmin(axis=1)
        least = bits.min(axis=1)
        rival = np.sort(bits, axis=1)[:, 1] if len(self.langs) > 1 else size * self.cost[0]
        ok = letters > 0
        phrases = found.min(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            out["score"] = np.where(ok & (rival > 0), np.clip((rival - least) / rival, 0, 1), 0.0)
            out["phrase_length"] = np.where(ok & (phrases > 0), size / phrases, 0.0)
        out["lang_pred"] = np.where(ok, np.array(self.langs, object)[best], "und")
        return out


def fit(docs: DataFrame) -> Parser:
    """Automata of labelled text, one per value of `lang`, from rows with text and lang.

    Fitted on a bounded sample: of each language the SAMPLE_DOCS documents whose
    ids hash lowest, CHARS_PER_DOC symbols of each, so a model's size does not
    grow with the collection. Rows that repeat a doc_id are one document with
    the least of their texts. Automata are built in tasks, one per language;
    only their transitions (two per sampled symbol or so) come to the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # Ranked among the rows of some tasks first, so the task that ranks a language hears few of each.
    near = Window.partitionBy("lang", "tasks").orderBy(*order)
    picked = (
        known.select("doc_id", "lang").distinct()
        .withColumn("tasks", F.floor(F.spark_partition_id() / TASKS_AT_ONCE))
        .withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= SAMPLE_DOCS)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        .where(F.col("rank") <= SAMPLE_DOCS).drop("tasks")
    )
    sample = (
        known.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])
        .groupBy("doc_id", "lang", "rank").agg(F.min("text").alias("text"))
    )
    edges = sample.groupBy("lang").applyInPandas(_edges, "lang string, state long, symbol string, target long, symbols long")
    return Parser(edges.toPandas())


def judged(docs: DataFrame, parser: Parser) -> DataFrame:
    """(row, lang_pred, score, phrase_length): each row as it came, judged by its whole text.

    Phrases are normalised by what one costs: the logarithm of the labelled
    text's length, since a longer one holds longer matches of anything. The
    language whose automaton needs the fewest normalised phrases wins, the first
    by name on a tie. `score` is the share that it saves against the runner up,
    0 to 1; `phrase_length` the longest mean phrase of any language in symbols. `und` with score 0
    for null text, text without a letter, or when nothing was learned.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    @F.pandas_udf("lang_pred string, score double, phrase_length double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            out, start, held = [], 0, 0
            for i, t in enumerate(texts):
                held += len(t or "")
                if held >= BATCH_CHARS:
                    out.append(shared.value.judge(texts[start:i + 1]))
                    start, held = i + 1, 0
            out.append(shared.value.judge(texts[start:]))
            yield pd.concat(out, ignore_index=True)
        give_back()

    return docs.select(F.struct("*").alias("row"), judge("text").alias("said")).select("row", "said.*")


def identify(docs: DataFrame, parser: Parser) -> DataFrame:
    """The columns of `docs` (but any of these names), then lang_pred, score, phrase_length of `judged`."""
    said = ("lang_pred", "score", "phrase_length")
    return judged(docs, parser).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in said], *said)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of(F.col("doc_id"), 3) == 1)
    parser = fit(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), parser).select("doc_id", "held_out", "lang_pred", "score")
