"""The scrubber: documents to findings and cleaned text.

A document is a row with ``document`` (its name, maybe null), ``doc_ord`` (its place in the order that
numbers follow) and ``text``. Detection, threshold, resolution and rendering are narrow: no shuffle, and
the same plan serves streams. Numbering detects once, into a checkpoint in which every row has a key of its own;
then it shuffles the findings, and the texts that have any.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.findings import FINDINGS, Finding
from palimpsest.limits import Limits
from palimpsest.locales import DEFAULT_LOCALE
from palimpsest.operators.detectors import Detector, PythonDetector
from palimpsest.operators.numbering import TokenMap, all_known, newly_numbered
from palimpsest.operators.registry import Registry, default_registry
from palimpsest.operators.render import Renderer, Token, rebuild, replaceable
from palimpsest.operators.resolve import Strategy, resolve
from palimpsest.plans.lineage import cut_lineage


@dataclass
class ScrubResult:
    """Lazy tables: documents with cleaned text, findings by row, and the token map after them."""

    documents: DataFrame
    findings: DataFrame
    tokens: TokenMap
    #: (document, doc_ord, detector, error): texts that a Python detector failed on, where that was looked for.
    failed: DataFrame | None = None
    #: (key, pii_type, index): what this run adds to the token map, where entities are numbered.
    new_entities: DataFrame | None = None


#: Columns of annotated documents: a row's own key, errors of detectors, findings before resolution.
_ROW, _FAILED, _FOUND = "_row", "_failed", "_n_found"


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def as_documents(source: DataFrame | Mapping[str, str] | Sequence[str], *, text_col: str = "text", id_col: str | None = None, order_col: str | None = None) -> DataFrame:
    """(document, doc_ord, text) from a table, a mapping of names to texts, or texts (named "0", "1", ...).

    A table without ``order_col`` or doc_ord is ordered by its ids, whatever their type. Ids may be null or repeat: each
    row is a document of its own.
    """
    if isinstance(source, DataFrame):
        order = F.col(order_col) if order_col else F.col("doc_ord") if "doc_ord" in source.columns else F.col(id_col) if id_col else F.monotonically_increasing_id()
        if id_col and not order_col and source.schema[id_col].dataType.typeName() in ("byte", "short", "integer"):
            order = order.cast("long")
        name = F.col(id_col) if id_col else F.col("document") if "document" in source.columns else order
        return source.select(name.cast("string").alias("document"), order.alias("doc_ord"), F.col(text_col).alias("text"))
    named = source.items() if isinstance(source, Mapping) else ((str(i), t) for i, t in enumerate(source))
    return _spark().createDataFrame([(n, i, t) for i, (n, t) in enumerate(named)], "document string, doc_ord long, text string")


class Scrubber:
    """Configuration of a run; two scrubbers share nothing."""

    def __init__(
        self, locale: str = DEFAULT_LOCALE, detectors: Sequence[str | Detector] | None = None, registry: Registry | None = None, min_score: float = 0.0, strategy: Strategy | str = Strategy.HIGHEST_SCORE,
        priority: Mapping[str, int] | None = None, renderer: Renderer | None = None, tokens: TokenMap | None = None, limits: Limits | None = None, on_detector_error: str = "warn",
    ) -> None:
        if on_detector_error not in ("warn", "raise", "ignore"):
            raise ValueError(f"on_detector_error is warn, raise or ignore, not {on_detector_error!r}")
        self.locale, self.min_score, self.strategy, self.priority = locale, min_score, Strategy(strategy), dict(priority or {})
        self.registry = default_registry() if registry is None else registry
        self.renderer, self.tokens, self.limits = Token() if renderer is None else renderer, TokenMap() if tokens is None else tokens, Limits() if limits is None else limits
        self.on_detector_error = on_detector_error
        self._running: dict[str, Detector] = {}
        names = None if detectors is None else [d for d in detectors if isinstance(d, str)]
        for entry in self.registry.select(locale, names):
            self.add_detector(self.registry.create(entry.name, locale))
        for detector in detectors or ():
            if not isinstance(detector, str):
                self.add_detector(detector)

    def __repr__(self) -> str:
        return f"<Scrubber {self.locale} {' '.join(self._running)}>"

    @property
    def detectors(self) -> tuple[Detector, ...]:
        return tuple(self._running.values())

    def add_detector(self, detector: Detector) -> None:
        """Run a detector, in the place of one with its name if there is one."""
        self._running[detector.name] = detector

    def remove_detector(self, name: str) -> None:
        self._running.pop(name, None)

    # columns

    def findings_column(self, text: Column, document: Column | None = None) -> Column:
        """What all detectors report of a text, above the threshold, in the order they run."""
        document = F.lit(None).cast("string") if document is None else document
        each = [d.findings(text, document, self.on_detector_error) for d in self.detectors]
        return self._above(F.concat(*each) if each else F.array().cast(FINDINGS))

    def _above(self, found: Column) -> Column:
        return F.filter(found, lambda f: f["score"] >= self.min_score) if self.min_score > 0 else found

    def resolve_column(self, findings: Column) -> Column:
        return resolve(findings, self.strategy, self.priority)

    # tables

    def annotate(self, docs: DataFrame) -> DataFrame:
        """Documents with ``findings`` resolved. Null texts have none."""
        return self._annotated(docs).drop(_FAILED, _FOUND)

    def _annotated(self, docs: DataFrame) -> DataFrame:
        """The same with the errors of Python detectors and the number of findings before resolution.

        The arrays of detection and of resolution are computed in steps of their own: each is used several
        times below, and an expression inlined there would run the patterns again.
        """
        each, failed, found = [], [], docs
        for i, d in enumerate(self.detectors):
            if isinstance(d, PythonDetector):
                found = _once(found.withColumn(f"_outcome{i}", d.outcome(F.col("text"), F.col("document"), self.on_detector_error)), f"_outcome{i}")
                error = F.col(f"_outcome{i}")["error"]
                failed.append(F.when(error.isNotNull(), F.struct(F.lit(d.name).alias("detector"), error.alias("error"))))
                each.append(F.coalesce(F.col(f"_outcome{i}")["findings"], F.array().cast(FINDINGS)))
            else:
                each.append(d.findings(F.col("text"), F.col("document"), self.on_detector_error))
        every = self._above(F.concat(*each) if each else F.array().cast(FINDINGS))
        errors = F.filter(F.array(*failed), lambda e: e.isNotNull()) if failed else F.array().cast("array<struct<detector:string,error:string>>")
        found = _once(found.select(*docs.columns, every.alias("_found"), errors.alias(_FAILED)), "_found")
        found = found.select(*docs.columns, _FAILED, F.size("_found").alias(_FOUND), self.resolve_column(F.col("_found")).alias("findings"))
        return _once(found, "findings")

    def check_limits(self, docs: DataFrame) -> None:
        """One aggregate over the lengths; raises LimitExceededError."""
        self.limits.check_documents(docs)

    def _detected(self, source: Any, check: bool | None, keep: bool, columns: dict[str, str]) -> tuple[DataFrame, DataFrame | None]:
        """Annotated documents and those that detectors failed on. Detection runs once: where its result is used at once, it is checkpointed."""
        docs = as_documents(source, **columns)
        check = not isinstance(source, DataFrame) if check is None else check
        if check:
            self.check_limits(docs)
        found = self._annotated(docs)
        warn = self.on_detector_error == "warn" and any(isinstance(d, PythonDetector) for d in self.detectors)
        if docs.isStreaming or not (check or keep or warn):
            return found.drop(_FAILED, _FOUND), None
        found = cut_lineage(found.withColumn(_ROW, F.monotonically_increasing_id()))
        if check:
            self.limits.check_count(found.agg(F.coalesce(F.sum(F.col(_FOUND).cast("long")), F.lit(0))).head()[0])
        failed = found.select("document", "doc_ord", F.explode(_FAILED).alias("f")).select("document", "doc_ord", "f.detector", "f.error")
        for row in failed.groupBy("detector", "error").count().orderBy("detector", "error").collect() if warn else ():
            warnings.warn(f"detector {row['detector']!r} failed on {row['count']} texts and was skipped there: {row['error']}", RuntimeWarning, stacklevel=4)
        return found.drop(_FAILED, _FOUND), failed

    def find_documents(self, source: Any, *, check: bool | None = None, **columns: str) -> DataFrame:
        """A row for each finding, with the fields of a finding and doc_ord. ``check`` as in ``scrub_documents``."""
        return explode_findings(self._detected(source, check, False, columns)[0])

    def scrub_documents(self, source: Any, *, check: bool | None = None, **columns: str) -> ScrubResult:
        """Cleaned documents, findings and token map.

        With ``check`` the limits are enforced first; by default they are for texts in memory, not for tables.
        Where an entity is first mentioned decides its number: by doc_ord and place, and where rows have the
        same doc_ord by the entity's key.
        """
        renderer, tokens = self.renderer, self.tokens
        annotated, failed = self._detected(source, check, renderer.needs_index, columns)
        spans = _once(annotated.withColumn("_spans", replaceable(F.col("findings"))), "_spans")
        hashed = lambda i: None
        if renderer.needs_hash:
            spans = _once(spans.withColumn("_hashes", renderer.hashes(F.transform("_spans", lambda f: f["text"]))), "_hashes")
            hashed = lambda i: F.get("_hashes", i)
        counts, new, index = tokens.counts, None, lambda i: None
        if renderer.needs_index:
            mentions = annotated.where(F.size("findings") > 0).select(_ROW, "doc_ord", F.posexplode(replaceable(F.col("findings"))).alias("at", "f"))
            mentions = mentions.select(_ROW, "at", "doc_ord", "f.beg", "f.pii_type", tokens.group_key(F.col("f")).alias("key"))
            new = cut_lineage(newly_numbered(mentions, tokens.counts))
            counts = all_known(tokens.counts, new)
            used = new if tokens.counts is None else cut_lineage(counts.join(mentions.select("key").distinct(), "key", "left_semi"))  # texts need no other numbers
            numbered = mentions.join(used.select("key", "index"), "key", "left").groupBy(_ROW).agg(F.array_sort(F.collect_list(F.struct("at", "index"))).alias("_numbers"))
            none = F.array().cast("array<struct<at:int,index:bigint>>")
            some = spans.where(F.size("_spans") > 0).join(numbered, _ROW)
            spans = some.unionByName(spans.where(F.size("_spans") == 0).withColumn("_numbers", none))
            index = lambda i: F.get("_numbers", i)["index"]
        placed = F.transform("_spans", lambda f, i: F.struct(f["beg"].alias("beg"), f["end"].alias("end"), f["text"].alias("original"), renderer.rendered(f, index(i), hashed(i)).alias("token")))
        ready = _once(spans.withColumn("_tokens", placed), "_tokens")
        cleaned = ready.withColumn("text", rebuild(F.col("text"), F.col("_tokens"), lambda t: t["token"])).select("document", "doc_ord", "text", "findings")
        after = TokenMap(tokens.group_key, tokens.keep_originals, counts, tokens.originals)
        if tokens.keep_originals and renderer.traceable:
            rendered = ready.select("doc_ord", F.explode("_tokens").alias("t"))
            latest = rendered.groupBy("t.token").agg(F.max_by("t.original", F.struct("doc_ord", "t.beg", "t.original")).alias("original"))
            old = tokens.originals
            after.originals = latest if old is None else old.join(latest.select("token"), "token", "left_anti").union(latest)
        return ScrubResult(cleaned, explode_findings(annotated), after, failed, new)

    def clean_documents(self, source: Any, **columns: str) -> DataFrame:
        """(document, doc_ord, text) cleaned."""
        return self.scrub_documents(source, **columns).documents.drop("findings")

    def clean_table(self, table: DataFrame, text_col: str = "text") -> DataFrame:
        """A table of any shape with one column cleaned; not for renderers that number entities."""
        if self.renderer.needs_index:
            raise ValueError("numbers hold across documents; use scrub_documents")
        if self.renderer.needs_hash:
            raise ValueError("hashes are made in batches; use scrub_documents")
        name = "_found"
        while name in table.columns:
            name = "_" + name
        found = _once(table.withColumn(name, self.findings_column(F.col(text_col))), name)
        spans = _once(found.withColumn(name, replaceable(self.resolve_column(F.col(name)))), name)
        return spans.withColumn(text_col, rebuild(F.col(text_col), F.col(name), self.renderer.render)).select(*table.columns)

    # single texts, on the driver

    def find(self, text: str, document: str | None = None) -> list[Finding]:
        docs = _spark().createDataFrame([(document, 0, text)], "document string, doc_ord long, text string")
        return [_finding(r) for r in self.find_documents(docs, check=True).orderBy("position").collect()]

    def scrub(self, text: str) -> tuple[str, list[Finding], TokenMap]:
        """Cleaned text, findings and token map; numbers carry on in this scrubber."""
        docs = _spark().createDataFrame([(None, 0, text)], "document string, doc_ord long, text string")
        result = self.scrub_documents(docs, check=True)
        cleaned = result.documents.head()["text"]
        if self.renderer.needs_index:
            payload = result.tokens.to_dict(include_originals=True)
            self.tokens = TokenMap.from_dict(_spark(), payload, self.tokens.group_key)
            self.tokens.keep_originals = result.tokens.keep_originals
            result.tokens = self.tokens
        return cleaned, [_finding(r) for r in result.findings.orderBy("position").collect()], result.tokens

    def clean(self, text: str) -> str:
        return self.scrub(text)[0]

    def detector_errors(self, docs: DataFrame) -> DataFrame:
        """(detector, error, documents): texts that Python detectors fail on, by kind of error."""
        failed = self._annotated(docs).select(F.explode(_FAILED).alias("f"))
        return failed.groupBy("f.detector", "f.error").agg(F.count("*").alias("documents"))


def _finding(row: Any) -> Finding:
    fields = ("beg", "end", "text", "pii_type", "detector", "score", "locale", "document")
    return Finding(*(row[f] for f in fields), row["context"] or {})


def _once(df: DataFrame, column: str) -> DataFrame:
    """Keep the optimizer from copying a column's expression to each of its uses.

    An explode of a one-element array is not merged with the projections around it, costs no shuffle and
    works on streams.
    """
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(F.array(F.col(column))).alias(column))


def explode_findings(annotated: DataFrame) -> DataFrame:
    rows = annotated.select("doc_ord", F.posexplode("findings").alias("position", "f"))
    fields = ("beg", "end", "text", "pii_type", "detector", "score", "locale", "document", "context")
    return rows.select("doc_ord", "position", *(F.col(f"f.{x}").alias(x) for x in fields))


def clean(text: str, locale: str = DEFAULT_LOCALE, **options: Any) -> str:
    """Clean one text with a scrubber for this call."""
    return Scrubber(locale, **options).clean(text)


def find(text: str, locale: str = DEFAULT_LOCALE, **options: Any) -> list[Finding]:
    """Find personal data in one text with a scrubber for this call."""
    return Scrubber(locale, **options).find(text)


__all__: list[str] = ["ScrubResult", "Scrubber", "as_documents", "clean", "explode_findings", "find"]
