"""Operator 5, token counts with a whole-token shortcut.

Offline proof, made once per vocabulary: (1) no piece holds a word mark after another character, so
merges never cross from a word into the next mark and a text's tokens are those of its pre-tokens;
(2) a vocabulary string counts as one token alone only if the library encodes it so. Pre-tokens that
match a proved string count one; the rest are merged by the library, once per distinct pre-token.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

MARK = "▁"
MODEL = "piece_bpe_32k.model"
CACHE, LONG = 400_000, 64  # pre-tokens remembered per Python worker, and the most characters of one that is


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def normalizer(model: bytes) -> dict[int, int | bytes]:
    """Fields of the normaliser's specification (field 3 of a sentencepiece model) by number: 2 character map, 3 prefix, 4 removal of extra spaces, 5 escaped spaces."""

    def fields(buf: bytes):
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = buf[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(buf):
            key = varint()
            if key & 7 == 0:
                yield key >> 3, varint()
            else:
                n = {1: 8, 5: 4}.get(key & 7) or varint()
                yield key >> 3, buf[at : at + n]
                at += n

    return dict(fields(b"".join(v for k, v in fields(model) if k == 3)))


class Counter:
    """Counts tokens of whole texts as the sentencepiece model at path gives them (no begin or end tokens)."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        special = {i for i in range(len(pieces)) if self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i)}
        normal = [p for i, p in enumerate(pieces) if i not in special]
        # The split is sound only under (1), and if the model neither rewrites text nor joins marks.
        self.splits = not any(MARK in p.lstrip(MARK) for p in normal) and not any("\n" in p for p in normal) and self._plain()
        words = [p[1:] for p in normal if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        self.whole = {MARK + w for w, t in zip(words, self.lib.encode(words, num_threads=1), strict=True) if len(t) == 1} if self.splits else set()
        self.seen: dict[str, int] = {}

    def _plain(self) -> bool:
        """The model keeps text as it is: spaces become marks one for one and one mark is put in front.

        That is what its normaliser's specification says (no character map, no removal of extra
        spaces, escaped spaces, a prefix), and probes confirm it.
        """
        spec = normalizer(self.lib.serialized_model_proto())
        if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1) or not spec.get(5, 1):
            return False
        for probe in (" a", "a  b ", "a\tb", "éﬁ①"):
            if self.lib.decode(self.lib.encode("x" + probe)) != "x" + probe:
                return False
        return self.lib.encode("a", out_type=str)[0].startswith(MARK)

    def rest(self, pre: list[str]) -> dict[str, int]:
        """Token counts of pre-tokens that are not proved whole. A line feed never merges, so it fences off the mark put in front."""
        fence = len(self.lib.encode("\n"))
        return {p: len(t) - fence for p, t in zip(pre, self.lib.encode(["\n" + p.replace(MARK, " ") for p in pre], num_threads=1), strict=True)}

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; new pre-tokens of all texts go to the library together."""
        if len(self.seen) > CACHE:
            self.seen.clear()
        whole, seen = self.whole, self.seen
        split: list[list[str] | int] = []
        for t in texts:
            if not t:
                split.append(0)
            elif not self.splits or "\0" in t or MARK in t:
                split.append(len(self.lib.encode(t)))
            else:
                split.append(SPLIT.findall(MARK + t.replace(" ", MARK)))
        rest = [x if isinstance(x, int) else [p for p in x if p not in whole] for x in split]
        missing = {p for x in rest if not isinstance(x, int) for p in x if p not in seen}
        long = {}
        if missing:
            for p, n in self.rest(sorted(missing)).items():
                (seen if len(p) <= LONG else long)[p] = n
        known = (lambda p: long[p] if p in long else seen[p]) if long else seen.__getitem__
        return [x if isinstance(x, int) else len(x) - len(r) + sum(map(known, r)) for x, r in zip(split, rest, strict=True)]

    def count(self, text: str) -> int:
        return self.counts([text])[0]


#: A run of marks with the word after it; line feeds stand alone.
SPLIT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, path: str | None = None, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit for each row of df.

    Null and empty texts have 0 bytes and 0 tokens. Rows are independent: repeated rows repeat, ties
    do not matter, other columns are ignored. Long pre-tokens go to the library whole.
    """
    path = path or model_path()
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches):
        c = counter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            tokens = [n for i in range(0, len(texts), 200) for n in c.counts(texts[i : i + 200])]
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], [key, "n_bytes", "n_tokens", "over_limit"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
