"""Renderers: what stands in a finding's place."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.validators import casefold


def digest(text: str, salt: bytes, length: int) -> str:
    """A keyed BLAKE2b fingerprint: its first hexadecimal digits, in upper case."""
    return hashlib.blake2b(text.encode(), key=salt, digest_size=32).hexdigest()[:length].upper()


class Renderer(ABC):
    #: Whether ``render`` needs to know the entity's number.
    needs_index = False
    #: Whether it needs the salted hash of the entity's text, from ``hashes``.
    needs_hash = False
    #: Whether replacements are tokens that can be traced back.
    traceable = False

    def rendered(self, finding: Column, index: Column | None, hashed: Column | None) -> Column:
        """The replacement, with the number and the hash that the renderer asked for."""
        return self.render(finding, index)

    @abstractmethod
    def render(self, finding: Column, index: Column | None = None) -> Column:
        """The replacement of one finding (a struct), never null."""


class Token(Renderer):
    """A label such as {{EMAIL}}, {{EMAIL-0}} or, salted, {{EMAIL-9F86D081}}."""

    traceable = True

    def __init__(self, prefix: str = "{{", suffix: str = "}}", include_kind: bool = True, include_count: bool = False, include_hash: bool = False, salt: str | bytes | None = None, hash_length: int = 8, uppercase: bool = True, separator: str = "-") -> None:
        if not any((include_kind, include_count, include_hash)):
            raise ValueError("a token shows its kind, its count or its hash")
        if include_hash and salt is None:
            raise ValueError("a hash needs a salt; without one anybody can reverse it")
        if hash_length < 1:
            raise ValueError(f"a hash has one digit at least, not {hash_length}")
        salt = salt.encode() if isinstance(salt, str) else salt
        if salt is not None and include_hash and not 1 <= len(salt) <= hashlib.blake2b.MAX_KEY_SIZE:
            raise ValueError(f"a salt has 1 to {hashlib.blake2b.MAX_KEY_SIZE} bytes")
        self.prefix, self.suffix, self.separator, self.uppercase = prefix, suffix, separator, uppercase
        self.include_kind, self.include_count, self.include_hash = include_kind, include_count, include_hash
        self.salt, self.hash_length, self.needs_index, self.needs_hash = salt, hash_length, include_count, include_hash

    def hashes(self, texts: Column) -> Column:
        """Hashes of an array of texts. Spark has no BLAKE2b: an Arrow-batched function, whose closure keeps the salt out of the plan."""
        salt, length = self.salt, self.hash_length

        def digests(lists: pd.Series) -> pd.Series:
            return pd.Series([None if some is None else [digest(t.casefold(), salt, length) for t in some] for some in lists], dtype=object)

        return F.pandas_udf(digests, "array<string>")(texts)

    def rendered(self, finding: Column, index: Column | None, hashed: Column | None) -> Column:
        parts = [F.replace(finding["pii_type"], F.lit(" "), F.lit("_"))] if self.include_kind else []
        parts += [index.cast("string")] if self.include_count else []
        parts += [hashed] if self.include_hash else []
        body = F.concat_ws(self.separator, *parts)
        return F.concat(F.lit(self.prefix), F.upper(body) if self.uppercase else body, F.lit(self.suffix))

    def render(self, finding: Column, index: Column | None = None) -> Column:
        return self.rendered(finding, index, F.get(self.hashes(F.array(finding["text"])), F.lit(0)) if self.include_hash else None)


class Mask(Renderer):
    """As many signs as there were characters, or a fixed number; the last few characters may stay."""

    def __init__(self, char: str = "*", keep_last: int = 0, fixed_length: int | None = None) -> None:
        if len(char) != 1:
            raise ValueError(f"a mask is made of one character, not {len(char)}")
        if keep_last < 0:
            raise ValueError(f"keep_last is {keep_last}; it must not be negative")
        if fixed_length is not None and fixed_length < 1:
            raise ValueError(f"fixed_length is {fixed_length}; it must be positive")
        self.char, self.keep_last, self.fixed_length = char, keep_last, fixed_length

    def render(self, finding: Column, index: Column | None = None) -> Column:
        width = F.lit(self.fixed_length) if self.fixed_length is not None else F.greatest(F.length(finding["text"]) - self.keep_last, F.lit(0))
        tail = F.right(finding["text"], F.lit(self.keep_last)) if self.keep_last else F.lit("")
        return F.concat(F.repeat(F.lit(self.char), width), tail)


class Remove(Renderer):
    """Nothing."""

    def render(self, finding: Column, index: Column | None = None) -> Column:
        return F.lit("")


class ColumnRenderer(Renderer):
    """A renderer from a function of the finding's column."""

    def __init__(self, function: Callable[[Column], Column]) -> None:
        self.function = function

    def render(self, finding: Column, index: Column | None = None) -> Column:
        return self.function(finding)


def replaceable(findings: Column) -> Column:
    """Of findings ordered by position those that begin at or after the end of the last one taken."""
    return F.aggregate(findings, F.slice(findings, 1, 0), lambda kept, f: F.when(f["beg"] >= F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0)), F.array_append(kept, f)).otherwise(kept))


def rebuild(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with disjoint ordered spans (structs with beg and end) replaced."""
    n = F.size(spans)
    starts = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
    pieces = F.transform(spans, lambda s, i: F.concat(F.substring(text, starts(i) + 1, s["beg"] - starts(i)), replacement(s)))
    rest = F.substring(text, F.get(spans, n - 1)["end"] + 1, F.length(text))
    return F.when(n > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)


def group_key(finding: Column) -> Column:
    """Kind and text without case: findings with one key are one entity."""
    return F.concat(finding["pii_type"], F.lit(":"), casefold(finding["text"]))
