"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.session import scratch_folder

#: The bytes that separate words in the contracts: space and U+0009 to U+000D.
WORD_SPACE = " \t\n\x0b\f\r"
#: A text is cut before each run of white space that follows another character. Every such point
#: starts a match of the tokenizers' pattern, so the pieces may be encoded apart. U+001C to U+001F
#: count as white space in Python only.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Python's bytes.translate table that lower-cases A-Z alone.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Two white spaces in a row: only there does the pattern's look-ahead matter.
_RUN = re.compile(r"\s\s")
_LOOK_AHEAD = r"|\s+(?!\S)"


def reachable(spark: SparkSession) -> SparkSession:
    """Let the Python workers import this package from where it lies; a cluster without it gets it with --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark


#: Folders written since the innermost ``freeing`` began.
_OWN: ContextVar[list[str] | None] = ContextVar("own", default=None)


def staged(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that later jobs start from there."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    if (own := _OWN.get()) is not None:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freeing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the folders staged inside when their work is done, but for those that frames handed to the given function read.

    The latter belong to the next outer context, if there is one. Frames that are still to be computed from other folders don't outlive this.
    """
    own, kept = [], set()

    def keep(df: DataFrame) -> DataFrame:
        files = df.inputFiles()
        kept.update(path for path in own if any(path.split("/")[-1] in f for f in files))
        return df

    token = _OWN.set(own)
    try:
        yield keep
    finally:
        _OWN.reset(token)
        if (outer := _OWN.get()) is not None:
            outer.extend(kept)
        for path in own:
            if path not in kept:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_of(df: DataFrame, column: str) -> Column:
    """The text column as a string, null read as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def other_columns(df: DataFrame, *left_out: str) -> tuple[list[Column], list[Column]]:
    """The columns of a frame but some, under names that no operator uses, and how to get them back under their own."""
    names = [c for c in df.columns if c.lower() not in {x.lower() for x in left_out}]
    return ([F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)], [F.col(f"in_{i}").alias(c) for i, c in enumerate(names)])


def words_of(text: str | None) -> list[bytes]:
    """Words between word spaces, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(LOWER).split()


class Encoder:
    """Byte-level BPE ids of whole texts from a rank file; made once in each Python worker."""

    _made: dict[tuple, Encoder] = {}

    def __init__(self, path: str, pattern: str, special: tuple[tuple[str, int], ...]):
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        make = lambda name, pat: tiktoken.Encoding(
            name, pat_str=pat, mergeable_ranks=self.ranks, special_tokens=dict(special))
        self.exact = make("exact", pattern)
        # Without look-ahead the pattern runs on a plain automaton; the matches are the same unless
        # two white spaces meet.
        self.plain = make("plain", pattern.replace(_LOOK_AHEAD, "")) if _LOOK_AHEAD in pattern else self.exact
        self.special = bool(special)

    @classmethod
    def of(cls, path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> Encoder:
        key = (path, pattern, special)
        if key not in cls._made:
            cls._made[key] = cls(path, pattern, special)
        return cls._made[key]

    def choose(self, text: str):
        return self.exact if _RUN.search(text) else self.plain

    def ids(self, text: str) -> list[int]:
        encoding = self.choose(text)
        return encoding.encode(text, allowed_special="all") if self.special else encoding.encode_ordinary(text)

    def for_parts(self, text: str) -> Callable[[str], list[int]]:
        """What gives the ids of any part of a text; where the look-ahead matters nowhere in the text, parts are not searched for it."""
        if self.special or _RUN.search(text):
            return self.ids
        return self.plain.encode_ordinary

    def array(self, text: str):
        """Ids as a numpy array of unsigned 32-bit numbers."""
        return self.choose(text).encode_to_numpy(text, allowed_special="all")


def json_vocabulary(name: str = "byte_bpe_50k") -> dict:
    """Rank file, pattern and special string of the vocabulary that ``name``.json holds too.

    Both files hold the same merges in the same order, so ids are equal to those of the library
    for the .json file (tested over all code points); the rank library is several times faster.
    """
    import public_tokenizers as P

    return {"path": P.path(f"{name}.tiktoken"), "pattern": P.PATTERN, "special": (("<|endoftext|>", 50256),)}
