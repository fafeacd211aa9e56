"""Token counts for a score-ordered BPE vocabulary with byte fallback.

The vocabulary marks a space by U+2581 and no piece has that mark after another
character, so no merge crosses a "character, mark" boundary: a text falls apart
into pre-tokens that can be counted alone. Before the job starts, the driver
proves by running the merges which vocabulary strings come out as one token; a
pre-token of that set counts 1 at once, and only the others are merged.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import append_from_text, quoted, share

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Pre-tokens whose counts a Python worker remembers.
CACHED_UNITS = 250_000
#: Up to this many symbols a plain list finds the best pair faster than a heap.
_SHORT = 48


class PieceCounter:
    """Counts the tokens of whole texts; ``costs`` maps each mergeable piece to its order (lowest first)."""

    def __init__(self, costs: dict[str, float], single: frozenset[str] | None = None):
        self.costs = costs
        self.parts = frozenset("".join(p for p in costs if len(p) > 1))
        self.single = single if single is not None else frozenset(p for p in costs if len(self.merge(p)) == 1)
        self.units = lru_cache(CACHED_UNITS)(self.count_unit)

    @classmethod
    def from_file(cls, path: str) -> PieceCounter:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as file:
            spec = proto.ModelProto.FromString(file.read())
        rules, training = spec.normalizer_spec, spec.trainer_spec
        wrong = {
            "is no byte-pair model": training.model_type != proto.TrainerSpec.BPE,
            "has no byte fallback": not training.byte_fallback,
            "normalises characters": bool(rules.precompiled_charsmap),
            "removes white space": rules.remove_extra_whitespaces,
            "begins texts without a space": not rules.add_dummy_prefix,
            "doesn't mark spaces before words": not rules.escape_whitespaces or training.treat_whitespace_as_suffix,
            "has symbols of its user": any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in spec.pieces),
        }
        if any(wrong.values()):
            raise ValueError(f"{path} {', '.join(k for k, v in wrong.items() if v)}: its tokens can't be counted this way")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
        ]
        costs = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in costs):
            raise ValueError("a piece has a space inside, so texts can't be split at spaces")
        return cls(costs)

    def merge(self, unit: str) -> list[str]:
        """The symbols that remain when the cheapest adjacent pair is joined until none is a piece."""
        if len(unit) > _SHORT:
            return self._merge_long(unit)
        symbols, costs, never = list(unit), self.costs, float("inf")
        pairs = [costs.get(a + b, never) for a, b in zip(symbols, symbols[1:], strict=False)]
        while pairs and (best := min(pairs)) < never:
            at = pairs.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = costs.get(symbols[at - 1] + symbols[at], never)
            if at < len(pairs):
                pairs[at] = costs.get(symbols[at] + symbols[at + 1], never)
        return symbols

    def _merge_long(self, unit: str) -> list[str]:
        n, costs = len(unit), self.costs
        end = list(range(1, n + 1))  # end[i]: where the live symbol that starts at i ends
        before = list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (cost := costs.get(unit[i : end[j]])) is not None:
                heapq.heappush(heap, (cost, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue  # one side has changed since
            alive[end[i]] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        symbols, i = [], 0
        while i < n:
            symbols.append(unit[i : end[i]])
            i = end[i]
        return symbols

    def count_unit(self, unit: str) -> int:
        if unit in self.single:
            return 1
        total, run = 0, []
        for c in unit:  # a character of no longer piece stays alone and ends a run
            if c in self.parts:
                run.append(c)
                continue
            total += self._count_run("".join(run)) + self._lone(c)
            run.clear()
        return total + self._count_run("".join(run))

    def _count_run(self, run: str) -> int:
        if not run or run in self.single:
            return len(run) and 1
        return sum(1 if len(s) > 1 else self._lone(s) for s in self.merge(run))

    def _lone(self, c: str) -> int:
        return 1 if c in self.costs else len(c.encode("utf-8", "surrogatepass"))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            units = Counter(_UNITS.findall(SPACE + text.replace(" ", SPACE)))
            return sum(n * self.units(u) for u, n in units.items())
        return sum(n * self.units(SPACE + w) for w, n in Counter(text.split(" ")).items())


_ready: dict[str, PieceCounter] = {}


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """Append n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to each row.

    Null and empty texts have 0 bytes and 0 tokens; of very long texts every
    token is counted. ``keep`` names the columns to carry along, by default all.
    """
    counter = PieceCounter.from_file(path)
    size = sum(map(len, counter.costs)) * 4 + 100 * len(counter.costs)
    shared = share(df.sparkSession, (counter.costs, counter.single), size)
    fields = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def make():
        if path not in _ready:
            _ready.clear()
            _ready[path] = PieceCounter(*shared.value)
        count = _ready[path].count

        def work(texts: list) -> list[pa.Array]:
            return [
                pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                pa.array([count(t or "") for t in texts], pa.int64()),
            ]

        return work

    out = append_from_text(df, text, fields, make, keep)
    kept = [F.col(quoted(c)) for c in out.columns if c != "over_limit"]
    return out.select(*kept, (F.col("n_tokens") > limit).alias("over_limit"))
