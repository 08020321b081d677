"""Token counts with a whole-token shortcut.

A vocabulary string that the library encodes alone as its own single id, and that the
pre-tokenizer leaves in one piece, always counts one token where it stands as a pre-token.
That is proved once for each vocabulary string, before the job starts, and sent to the workers (its
size is the vocabulary's); the other pre-tokens are merged by the library, each distinct one once.

Pre-tokens never span a blank that follows a character other than white space and comes before another one,
so a text can be cut there.  Stretches with characters beyond U+024F, whose classes depend on the version of
Unicode, go through the library; the rest of the text takes the shortcut.

Edge cases: a null or empty text has 0 tokens and 0 bytes; a very long text is counted whole; repeated rows are
counted separately; a null key stays null; an empty table gives an empty table; other columns of the input are
ignored, whatever their names.  Texts with a special token's string go through the library whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm._util import slices, strings
from tidewell.sources.package import in_batches

# The classes letter, number and white space of the code points up to U+024F.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\\t\\n\\x0b\\x0c\\r \x85\xa0"
PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BEYOND = re.compile("[^\x00-ɏ]")
#: Where a text with characters beyond can be cut: before such a blank.
CUT = re.compile(f"(?<=[^{SPACE}\u0250-\U0010ffff])(?= [^{SPACE}\u0250-\U0010ffff])")
#: Distinct merged pre-tokens in each of the two generations that a worker remembers.
REMEMBERED = 300_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it shows, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


LETTERS = byte_letters()


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


@functools.lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and encode alone as one token."""
    tok = tokenizer(path)
    ids = sorted(tok.get_vocab(with_added_tokens=False).values())
    said = tok.decode_batch([[i] for i in ids], skip_special_tokens=False)
    coded = tok.encode_batch(said, add_special_tokens=False)
    return frozenset(s for i, s, e in zip(ids, said, coded, strict=True) if e.ids == [i] and not BEYOND.search(s) and PIECE.findall(s) == [s])


class Merged(dict):
    """Pre-token to what ``of`` makes of its merged tokens; the library's model is asked once for each.

    When a generation is full it becomes the old one, from which words still in use are taken over.
    """

    def __init__(self, tok: Tokenizer, of: Callable[[list], object]):
        self.model, self.of, self.old = tok.model, of, {}

    def __missing__(self, piece: str):
        if (found := self.old.get(piece)) is None:
            found = self.of(self.model.tokenize(piece.encode().decode("latin-1").translate(LETTERS)))
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class Counter:
    """Counts tokens; ``whole``: the strings that ``whole_tokens`` proved."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        self.tok, self.whole = tokenizer(path), whole_tokens(path) if whole is None else whole
        self.merged = Merged(self.tok, len)
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]

    def by_library(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if any(x in text for x in self.special):
            return self.by_library(text)
        if BEYOND.search(text):
            return sum(self.by_library(x) if BEYOND.search(x) else self.shortcut(x) for x in CUT.split(text))
        return self.shortcut(text)

    def shortcut(self, text: str) -> int:
        pieces = PIECE.findall(text)
        whole, merged = self.whole, self.merged
        rest = [p for p in pieces if p not in whole]
        return len(pieces) - len(rest) + sum(map(merged.__getitem__, rest))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``key``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``), one for each row."""
    kind = docs.schema[key].dataType.simpleString()
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary))  # as large as the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary, proved.value)
        for b in (part for whole in batches for part in slices(whole)):
            n = [counter.count(x) for x in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

    thin = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    found = thin.transform(in_batches, count, f"key {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")
