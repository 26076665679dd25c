"""Token counts by byte-pair merging, without ids.

A text is normalised as the model says and cut where no piece of its
vocabulary spans, so that no merge can reach across. Within such a part the
pair of neighbours of the best score merges first, the leftmost of equals, as a
heap gives them; a linked list holds the neighbours. The count is the initial
symbols less the merges, where a character that is no piece and never merges
counts as its bytes. Rows are independent of one another, so nothing moves, and
a lost executor costs its tasks alone.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import texts

#: Parts whose counts a worker remembers, each of at most so many characters; others are counted anew each time.
REMEMBERED, REMEMBERED_CHARS = 1 << 19, 32
#: Characters of a text that are cut into parts at once.
STRETCH = 1 << 20
BLANK = "▁"
#: Values of the model format: the kind of model, and the types of pieces.
_BPE, _NORMAL, _USER_DEFINED, _UNUSED = 2, 1, 4, 5


class Counter:
    """Counts tokens as the sentencepiece model at ``path``, one of byte-pair merges with byte fallback, gives them."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        with open(path, "rb") as file:
            raw = file.read()
        model = ModelProto()
        model.ParseFromString(raw)
        if model.trainer_spec.model_type != _BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("only byte-pair models with byte fallback are counted")
        if any(p.type in (_USER_DEFINED, _UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not counted")
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == _NORMAL}
        self.normalise = SentencePieceProcessor(model_proto=raw).normalize
        self.parts, self.start = self._cuts()
        self.remembered = lru_cache(REMEMBERED)(self.part)

    def _cuts(self) -> tuple[re.Pattern, re.Pattern | None]:
        """What finds the parts of a text, and where it may be cut first: both by pairs of characters that no piece holds.

        A part ends before blanks, around a line end or tabulator that stands alone in the vocabulary, and between a letter
        and a sign which no piece has behind a letter.
        """
        joined = {piece[i : i + 2] for piece in self.cost for i in range(len(piece) - 1)}
        if any(pair[1] == BLANK != pair[0] for pair in joined):
            return re.compile("(?s).+"), None
        alone = {c for c in "\t\n\r" if not any(c in pair for pair in joined)}
        bound = {q for p, q in joined if p.isalnum() and not q.isalnum()}
        lone, joins = (f"[{''.join(map(re.escape, sorted(c)))}]" if c else "(?:(?!))" for c in (alone, bound))
        letter, sign = r"[^\W_]", rf"(?:[^\w{BLANK}{''.join(map(re.escape, sorted(alone)))}]|_)"
        onward = f"{letter}*(?:{joins}{sign}*{letter}*)*"
        return re.compile(f"{BLANK}+{sign}*{onward}|{letter}{onward}|{sign}+{onward}|{lone}"), re.compile(f"(?<!{BLANK}){BLANK}")

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        text, at, count = self.normalise(text), 0, 0
        while at < len(text):
            stop = len(text)
            if self.start and stop - at > STRETCH and (found := self.start.search(text, at + STRETCH)):
                stop = found.start()
            for part in self.parts.findall(text, at, stop):
                count += self.remembered(part) if len(part) <= REMEMBERED_CHARS else self.part(part)
            at = stop
        return count

    def part(self, run: str) -> int:
        """Initial symbols less merges."""
        cost, n = self.cost, len(run)
        symbols: list[str | None] = list(run)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(cost[pair], i, pair) for i in range(n - 1) if (pair := run[i : i + 2]) in cost]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            if symbols[i] is None or (j := right[i]) == n or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue  # one of the two has merged with another since
            symbols[i], symbols[j] = pair, None
            merges += 1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (new := pair + symbols[k]) in cost:
                    heapq.heappush(heap, (cost[new], i, new))
            if (h := left[i]) >= 0 and (new := symbols[h] + pair) in cost:
                heapq.heappush(heap, (cost[new], h, new))
        return n - merges + sum(len(s.encode()) - 1 for s in symbols if s is not None and s not in cost)


def counter(path: str) -> Callable[[Column], Column]:
    """The column of token counts of a column of texts."""

    @F.arrow_udf("long")
    def counted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = Counter(path)
        for column in columns:
            yield pa.array([count(value.as_py()) for value in column], pa.int64())

    return counted


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs``.

    ``path`` names a sentencepiece model that all machines can read. A null text counts as
    empty, and an empty text has no tokens; rows with a null or repeated id each
    keep their own row; an empty table gives an empty result; other columns, whatever their names, are not
    read. Text is counted whole at every length; a special token's string inside it is ordinary text.
    """
    counted = texts(docs, id_col, text_col).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), counter(path)("text").alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
