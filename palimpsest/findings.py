"""What a finding is: a row shape for Spark and a small class for the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

#: The kinds that have a name here; any other string is a kind as well.
KINDS = "credential credit_card date_of_birth email iban ip name phone postal_code secret url uuid".split()

FINDING = "struct<beg:int,end:int,text:string,pii_type:string,detector:string,score:double,locale:string,document:string,context:map<string,string>>"
FINDINGS = f"array<{FINDING}>"


@dataclass(frozen=True)
class Finding:
    """A half-open span of characters; equality leaves the context out, and repr the text."""

    beg: int
    end: int
    text: str = field(repr=False)
    pii_type: str
    detector: str
    score: float = 1.0
    locale: str | None = None
    document: str | None = None
    context: dict[str, str] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        problems = [
            (self.beg < 0, "it starts before the text"),
            (self.end <= self.beg, "it is empty or inverted"),
            (len(self.text) != self.end - self.beg, "its text and span differ in length"),
            (not 0 <= self.score <= 1, "its score is outside 0 to 1"),
            (not self.pii_type, "it has no kind"),
            (not self.detector, "it has no detector"),
        ]
        for wrong, why in problems:
            if wrong:
                raise ValueError(f"not a finding [{self.beg}, {self.end}): {why}")

    def __len__(self) -> int:
        return self.end - self.beg

    def overlaps(self, other: Finding) -> bool:
        """Whether a character belongs to both; touching is not overlapping."""
        return max(self.beg, other.beg) < min(self.end, other.end)

    def shift(self, offset: int) -> Finding:
        return replace(self, beg=self.beg + offset, end=self.end + offset)

    def to_dict(self, include_text: bool = False) -> dict[str, Any]:
        """For an audit trail: empty fields are left out, and the text unless it is asked for."""
        out: dict[str, Any] = {name: getattr(self, name) for name in ("beg", "end", "pii_type", "detector", "score")}
        out |= {name: getattr(self, name) for name in ("locale", "document") if getattr(self, name) is not None}
        out |= {"context": dict(self.context)} if self.context else {}
        return out | ({"text": self.text} if include_text else {})
