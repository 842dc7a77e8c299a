"""Secret scans by grammar inference.

Candidates are the whole values behind a telling key (``KEYS``), up to the closing quote or, without quotes, to white space,
whatever their length and characters; and elsewhere runs of at least ``SHORTEST`` of the characters A-Z a-z 0-9 + / _ - other
than plain words (lower case with perhaps a capital first).

The key, or a published prefix (``PREFIXES``), labels a candidate. Of each kind a bounded sample of distinct labelled values
(``SAMPLE``, by least hash) forms a
prefix tree whose states are merged, level by level, when Hoeffding's bound can't tell their
symbol distributions apart, down to ``LOOK`` symbols ahead. The result is an acyclic probabilistic
automaton, which keeps a format's length; a task fits a kind. Every candidate of every document is then scored by each automaton: the
log likelihood over that of random symbols. A candidate is a secret when the best score reaches that of
all but the lowest hundredth of the labelled values, each half scored by an automaton fitted on the other, less a slack; so values without any telling key are found by their format.

Values that people choose (``FREE``) have no format that tells them from other text: their automata score candidates behind a key only, and are
fitted on all values without white space; the others are fitted on values that would be candidates without their key.

Defined results: null and empty texts have no candidates; with no labelled value no candidate is a
secret and kind and score are null; an empty value is no candidate; every occurrence is a row, also in repeated rows; of equal scores the first kind by
name wins; null ids are kept; other columns are not read. Values never leave the operator: rows
hold positions, in characters.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Collection, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.staging import materialise

SHORTEST = 12
SAMPLE = 2000
ALPHA = 0.01
LOOK = 2
PSEUDO = 20.0
SLACK = 3.0
LEAST = 8.0
END = ""
RUN = re.compile(rf"[A-Za-z0-9+/_\-]{{{SHORTEST},}}")
PLAIN = re.compile(r"[A-Za-z]?[a-z]*\Z")
PREFIXES = {"AKIA": "access_key", "ASIA": "access_key", "ghp_": "repo_token", "xoxb-": "chat_token", "AIza": "api_key"}
#: Telling keys, as patterns, and the kinds of the values behind them.
KEYS = {"token": "token", "secret": "secret", "api_?key": "api_key", "password": "password", "passwd": "password", "pwd": "password"}
FREE = frozenset({"password"})
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/_-")
_CLASS = defaultdict(lambda: len(_CLASSES), {c: k for k, s in enumerate(_CLASSES) for c in s})
#: Symbols of each class; the last is that of all other characters.
_SIZES = (*map(len, _CLASSES), 64)
_RANDOM = -math.log(64)


def keyed(keys: Mapping[str, str] = KEYS) -> re.Pattern:
    """The pattern of a key and its value, which one of the last three groups holds."""
    names = "|".join(f"({k})" for k in keys)
    return re.compile(rf"(?:{names})[\"')\]]{{0,2}}\s*[:=]\s*(?:\"([^\"\n]*)\"|'([^'\n]*)'|[\"']?([^\s\"'<>]+))", re.I)


def candidates(text: str, pattern: re.Pattern = keyed(), kinds: tuple[str, ...] = tuple(KEYS.values()), prefixes: Mapping[str, str] = PREFIXES):
    """(start, value, kind or None, whether it stands behind a key) of each candidate."""
    n, spans = len(kinds), []
    for m in pattern.finditer(text):
        group = next(g for g in (n + 1, n + 2, n + 3) if m.group(g) is not None)
        value = m.group(group)
        if group == n + 3:  # what ends a clause isn't part of a value without quotes
            value = value.rstrip(",;)")
        if value:
            start = m.start(group)
            spans.append((start, start + len(value)))
            known = next((kind for prefix, kind in prefixes.items() if value.startswith(prefix)), None)
            yield start, value, known or kinds[next(g for g in range(n) if m.group(g + 1) is not None)], True
    k = 0
    for m in RUN.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        value = m.group()
        if not (k < len(spans) and spans[k][0] < m.end()) and not PLAIN.match(value):
            yield m.start(), value, next((kind for prefix, kind in prefixes.items() if value.startswith(prefix)), None), False


def teaches(value: str, kind: str, free: Collection[str] = FREE) -> bool:
    """Whether an automaton of the kind is fitted on the value."""
    return not re.search(r"\s", value) if kind in free else bool(RUN.fullmatch(value) and not PLAIN.match(value))


class Automaton:
    """An acyclic probabilistic automaton of one kind of credential."""

    def __init__(self, values: list[str], alpha: float = ALPHA, look: int = LOOK):
        self.values, self.look = values, look
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        #: by level: [symbol counts, {symbol: state of the next level}, most common next state]
        self.levels: list[list[list]] = []
        level = [list(range(len(values)))]
        depth = 0
        while level:
            states, children = [], []
            for rows in level:
                split = self._split(rows, depth)
                states.append([Counter({c: len(r) for c, r in split.items()}), {}, None])
                children += [(len(states) - 1, c, r) for c, r in split.items() if c != END]
            merged: list[list[int]] = []
            for state, symbol, rows in sorted(children, key=lambda x: (-len(x[2]), x[0], x[1])):
                for k, other in enumerate(merged):
                    if self._alike(other, rows, depth + 1, look):
                        other += rows
                        break
                else:
                    k = len(merged)
                    merged.append(list(rows))
                states[state][1][symbol] = k
            for state in states:
                known = {c: n for c, n in state[0].items() if c != END}
                state[2] = state[1][max(known, key=lambda c: (known[c], c))] if known else None
                state.append(self._weights(state[0]))
            self.levels.append(states)
            level, depth = merged, depth + 1
        del self.values
        self.threshold = math.inf

    def _split(self, rows: list[int], depth: int) -> dict[str, list[int]]:
        out = defaultdict(list)
        for r in rows:
            v = self.values[r]
            out[v[depth] if depth < len(v) else END].append(r)
        return out

    def _alike(self, a: list[int], b: list[int], depth: int, look: int) -> bool:
        x, y = self._split(a, depth), self._split(b, depth)
        limit = self.bound * (1 / math.sqrt(len(a)) + 1 / math.sqrt(len(b)))
        if any(abs(len(x.get(c, ())) / len(a) - len(y.get(c, ())) / len(b)) > limit for c in x.keys() | y.keys()):
            return False
        return not look or all(self._alike(x[c], y[c], depth + 1, look - 1) for c in x.keys() & y.keys() if c != END and min(len(x[c]), len(y[c])) > 8)

    @staticmethod
    def _weights(counts: Counter) -> tuple[dict[str, float], list[float], float]:
        """Log probabilities of seen symbols, of others by class, and of the end."""
        n = sum(counts.values())
        by_class = [0.0] * len(_SIZES)
        for c, k in counts.items():
            if c != END:
                by_class[_CLASS[c]] += k
        rest = [PSEUDO * (k + 0.01) / (n + 0.1) / size for k, size in zip(by_class, _SIZES)]
        seen = {c: math.log((k + rest[_CLASS[c]]) / (n + PSEUDO)) for c, k in counts.items() if c != END}
        return seen, [math.log(r / (n + PSEUDO)) for r in rest], math.log((counts[END] + 1e-4) / (n + PSEUDO))

    def score(self, value: str) -> float:
        """Log likelihood of the value over that of random symbols."""
        total, state = 0.0, 0
        for depth, c in enumerate(value):
            if depth >= len(self.levels) or state is None:
                return total - 12.0 * (len(value) - depth)
            _, following, common, (seen, others, _) = self.levels[depth][state]
            total += seen.get(c, others[_CLASS[c]]) - _RANDOM
            state = following.get(c, common)
        if state is None or len(value) >= len(self.levels):
            return total - 12.0
        return total + self.levels[len(value)][state][3][2]


def learn(values: list[str]) -> Automaton:
    """An automaton of all values; its threshold comes from values that were not fitted, half by half."""
    halves = values[::2], values[1::2]
    fitted, scores = Automaton(values), []
    for a, b in (halves, halves[::-1]):
        if a and b:
            half = Automaton(a)
            scores += [half.score(v) for v in b]
    scores = sorted(scores or [fitted.score(v) for v in values])
    fitted.threshold = max(LEAST, scores[len(scores) // 100] - SLACK)
    return fitted


def _find(keys: Mapping[str, str], prefixes: Mapping[str, str], free: Collection[str]):
    names = ["doc_id", "start", "value", "label", "keyed", "taught"]

    def run(batches):
        pattern, kinds = keyed(keys), tuple(keys.values())
        for batch in batches:
            rows = [(i, *c) for i, text in enumerate(batch.column("text").to_pylist()) if text for c in candidates(text, pattern, kinds, prefixes)]
            which, starts, values, labels, behind = zip(*rows) if rows else ([],) * 5
            taught = [kind is not None and teaches(value, kind, free) for value, kind in zip(values, labels)]
            cols = [pa.array(c, t) for c, t in ((starts, pa.int64()), (values, pa.string()), (labels, pa.string()), (behind, pa.bool_()), (taught, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(which, pa.int64())), *cols], names=names)

    return run


def _grow(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"label": pdf["label"].iloc[:1], "automaton": [pickle.dumps(learn(sorted(pdf["value"])))]})


def fit(found: DataFrame, sample: int = SAMPLE) -> dict[str, Automaton]:
    """An automaton of each kind from at most ``sample`` distinct labelled values; kinds are fitted side by side."""
    values = found.filter("taught").select("label", "value").distinct()
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("value"), "value"))
    taken = values.withColumn("k", rank).filter(F.col("k") <= sample).select("label", "value")
    rows = taken.groupBy("label").applyInPandas(_grow, "label string, automaton binary").collect()  # one row a kind
    return {r.label: pickle.loads(r.automaton) for r in sorted(rows, key=lambda r: r.label)}


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, keys: Mapping[str, str] = KEYS, prefixes: Mapping[str, str] = PREFIXES, free: Collection[str] = FREE) -> DataFrame:
    """(doc_id, start, length, kind, score, secret) of every candidate; kind is the automaton of best score."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = materialise(texts.mapInArrow(_find(keys, prefixes, free), f"doc_id {kind}, start long, value string, label string, keyed boolean, taught boolean"), "candidates")
    automata = fit(found, sample)

    def run(batches):
        for batch in batches:
            known: dict[tuple[str, bool], tuple] = {}
            out = []
            for value in zip(batch.column("value").to_pylist(), batch.column("keyed").to_pylist()):
                if value not in known:
                    best = None, None, False
                    for name, automaton in automata.items():
                        if value[1] or name not in free:
                            s = automaton.score(value[0])
                            if best[1] is None or s > best[1]:
                                best = name, s, s >= automaton.threshold
                    known[value] = len(value[0]), *best
                out.append(known[value])
            size, kinds, scores, secret = zip(*out) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(size, pa.int32()), pa.array(kinds, pa.string()), pa.array(scores, pa.float64()), pa.array(secret, pa.bool_())], names=["doc_id", "start", "length", "kind", "score", "secret"])

    return found.mapInArrow(run, f"doc_id {kind}, start long, length int, kind string, score double, secret boolean")
