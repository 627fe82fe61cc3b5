"""Palimpsest: find and remove personal data in tables of documents, as Spark plans."""

from palimpsest.errors import DetectorError, DuplicateDetectorError, LimitExceededError, MissingDependencyError, PalimpsestError, UnknownDetectorError
from palimpsest.findings import Finding
from palimpsest.limits import Limits
from palimpsest.locales import DEFAULT_LOCALE
from palimpsest.operators.detectors import Detector, PythonDetector, PythonRegexDetector, RegexDetector
from palimpsest.operators.numbering import TokenMap
from palimpsest.operators.registry import Entry, Registry, default_registry
from palimpsest.operators.render import ColumnRenderer, Mask, Remove, Renderer, Token
from palimpsest.operators.resolve import Strategy
from palimpsest.plans.engine import Scrubber, ScrubResult, clean, find

__version__ = "0.1.0"

__all__ = [
    "DEFAULT_LOCALE", "ColumnRenderer", "Detector", "DetectorError", "DuplicateDetectorError", "Entry", "Finding", "LimitExceededError", "Limits", "Mask", "MissingDependencyError", "PalimpsestError",
    "PythonDetector", "PythonRegexDetector", "RegexDetector", "Registry", "Remove", "Renderer", "ScrubResult", "Scrubber", "Strategy", "Token", "TokenMap", "UnknownDetectorError", "__version__", "clean",
    "default_registry", "find",
]
