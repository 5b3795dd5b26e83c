"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts reach the Python workers in Arrow batches. There they are gathered into calls of at most CALL_BYTES,
so that calls are balanced by bytes and not by rows; long texts are cut at safe boundaries, places over
which the vocabulary cannot merge, so that the sum over the parts is the count of the whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches

CALL_BYTES = 1 << 20
#: Characters of a part of a long text.
PART_CHARS = 1 << 18
#: What a worker remembers of the lengths of recent parts; it is emptied beyond that.
CACHE_BYTES = 48 << 20

SPACED = re.compile(" *[^ ]+| +")


class PieceCounter:
    """Counts by a sentencepiece model.

    A part is a run of blanks with the non-blanks that follow. If no piece holds a blank after another
    character and blanks are not normalised, no merge crosses from one part into the next, and the prefix that
    the library puts before a text stands for a part's first blank.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        self.safe = not any("▁" in p.lstrip("▁") for p in pieces) and self._plain()
        self.cache: dict[str, int] = {"": 1}
        self.room = CACHE_BYTES

    def _plain(self) -> bool:
        """Whether the model adds one prefix blank and leaves all others as they are."""
        try:
            from sentencepiece import sentencepiece_model_pb2

            proto = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        except ImportError:
            return False
        spec = proto.normalizer_spec
        return spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap and not proto.trainer_spec.treat_whitespace_as_suffix

    @staticmethod
    def parts(text: str) -> list[str]:
        if text[0] != " " and "  " not in text:
            return text.split(" ")
        first, *rest = SPACED.findall(text)
        return [first, *(x[1:] for x in rest)]

    def learn(self, parts: set[str]) -> None:
        call, size = [], 0
        for x in parts:
            call.append(x)
            size += len(x) + 100
            if size > CALL_BYTES:
                self._put(call, size)
                call, size = [], 0
        self._put(call, size)

    def _put(self, call: list[str], size: int) -> None:
        self.room -= size
        for x, ids in zip(call, self.model.encode(call, num_threads=1), strict=True):
            self.cache[x] = len(ids)

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.safe:
                out[i] = len(self.model.encode(text, num_threads=1))
                continue
            parts = self.parts(text)
            try:
                out[i] = sum(map(self.cache.__getitem__, parts))
            except KeyError:
                self.learn({x for x in parts if x not in self.cache})
                out[i] = sum(map(self.cache.__getitem__, parts))
                if self.room < 0:
                    self.cache, self.room = {"": 1}, CACHE_BYTES
        return out


class FileCounter:
    """Counts by a file of the tokenizers library, in calls balanced by bytes.

    Long texts are cut before a blank between two characters that are no white space, if the file begins a token at
    every such blank, which is tried on a few texts; else they are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        ids = lambda t: self.model.encode(t, add_special_tokens=False).ids
        self.safe = all(ids(a + b) == ids(a) + ids(b) for a, b in (("one", " two"), ("a.", " 's"), ("é\n9", " 9,"), ("x", " <|endoftext|>"), ("ab", " ab"), ("1", " 2")))

    def parts(self, text: str) -> list[str]:
        """The text, cut at safe boundaries into parts of about PART_CHARS."""
        out, begin = [], 0
        while self.safe and len(text) - begin > PART_CHARS:
            at = text.rfind(" ", begin + 1, begin + PART_CHARS)
            while at > begin and (text[at - 1].isspace() or text[at + 1 : at + 2].isspace()):
                at = text.rfind(" ", begin + 1, at)
            if at <= begin:  # none within reach: the next one behind
                at = next((m.start() + 1 for m in re.compile(r"\S \S").finditer(text, begin + PART_CHARS - 1)), len(text))
            if at >= len(text):
                break
            out.append(text[begin:at])
            begin = at
        return [*out, text[begin:]]

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        out, call, owner, size = np.zeros(len(texts), np.int64), [], [], 0

        def count() -> None:
            for k, x in zip(owner, self.model.encode_batch_fast(call, add_special_tokens=False), strict=True):
                out[k] += len(x)
            call.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for part in self.parts(text) if text else ():
                call.append(part)
                owner.append(i)
                size += len(part)
                if size > CALL_BYTES:
                    count()
                    size = 0
        count()
        return out


_counters: dict[str, PieceCounter | FileCounter] = {}


def counter(path: str) -> PieceCounter | FileCounter:
    """One counter a worker process and file."""
    if path not in _counters:
        _counters[path] = (PieceCounter if path.endswith(".model") else FileCounter)(path)
    return _counters[path]


def count_tokens(docs: DataFrame, file: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit for every row.

    file is a name for ``public_tokenizers.path`` or a path that executors have. A null text counts as the
    empty text: 0 bytes, 0 tokens, not over the limit. Texts are counted whole, however long. Repeated rows and rows
    with a null id are counted like any other; columns of docs named as the three are replaced, others stay. An empty
    table gives an empty table.
    """

    @over_batches("long")
    def tokens(texts: pa.Array) -> pa.Array:
        import public_tokenizers

        found = counter(file if "/" in file else public_tokenizers.path(file))
        step = 256
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(found.lengths(texts.slice(i, step).to_pylist()) for i in range(0, len(texts), step))]))

    return docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": tokens(F.col(text))}).withColumn("over_limit", F.col("n_tokens") > limit)
