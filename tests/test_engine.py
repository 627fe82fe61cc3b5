"""Resolution, rendering, numbering and the scrubber, on small tables."""

import hashlib
import io
import json
import random
import re
import sys
import time
import types

import pytest
from pyspark.sql import functions as F

import palimpsest
from palimpsest import (
    ColumnRenderer, DetectorError, DuplicateDetectorError, Entry, Finding, LimitExceededError, Limits, Mask, MissingDependencyError, PythonDetector, Registry, Remove, Scrubber, Strategy, Token, TokenMap, UnknownDetectorError, clean,
    default_registry, find,
)
from palimpsest.cli import main
from palimpsest.findings import FINDINGS
from palimpsest.functions import validators
from palimpsest.locales import matches_locale, parse_locale
from palimpsest.operators.resolve import resolve, resolve_rows

TEXT = "mail joe@example.com, card 4111 1111 1111 1111"


def spans(*rows):
    """(beg, end, kind, detector, score) to findings."""
    full = [(*r, *("email", None, 1.0)[len(r) - 2 :]) for r in rows]
    return [{"beg": b, "end": e, "text": "x" * (e - b), "pii_type": k, "detector": d or k, "score": float(s), "locale": None, "document": None, "context": None} for b, e, k, d, s in full]


def resolved(spark, cases, strategy=Strategy.HIGHEST_SCORE, priority=None):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, f {FINDINGS}")
    return [r.f for r in df.select("i", resolve(F.col("f"), strategy, priority).alias("f")).orderBy("i").collect()]


def greedy(findings, strategy, priority):
    key = lambda f: ((f["end"] - f["beg"], f["score"]) if strategy == "longest" else (f["score"], f["end"] - f["beg"])) + (priority.get(f["detector"], 0), -f["beg"])
    taken = []
    for f in sorted(findings, key=key, reverse=True):
        if all(f["beg"] >= t["end"] or t["beg"] >= f["end"] for t in taken):
            taken.append(f)
    return sorted(taken, key=lambda f: (f["beg"], -f["end"]))


def test_resolution_goldens(spark):
    pair = spans((0, 10, "email", "weak", 0.5), (0, 4, "email", "strong", 0.9))
    at = lambda out: [(f.beg, f.end) for f in out]
    assert at(resolved(spark, [pair])[0]) == [(0, 4)]
    assert at(resolved(spark, [pair], "longest")[0]) == [(0, 10)]
    names = spans((0, 6, "name"), (4, 10, "email"))
    merged = resolved(spark, [names, spans((0, 5, "name"), (5, 10, "email")), []], "merge")
    assert at(merged[0]) == [(0, 10)] and merged[0][0].pii_type == "email+name" and merged[0][0].context == {"merged": "2"} and merged[0][0].text == "x" * 10
    assert at(merged[1]) == [(0, 5), (5, 10)] and merged[2] == []
    assert len(resolved(spark, [names], "keep_all")[0]) == 2
    assert at(resolved(spark, [spans((0, 30, "a", "weak", 0.4), (0, 5, "a", "s", 0.9), (20, 25, "a", "s", 0.9))])[0]) == [(0, 5), (20, 25)]
    equal = spans((0, 5, "k", "a", 0.5), (0, 5, "k", "b", 0.5))
    assert [resolved(spark, [equal], priority=p)[0][0].detector for p in ({"a": 1}, {"b": 1}, {})] == ["a", "b", "a"]


@pytest.mark.parametrize("strategy", ["highest_score", "longest", "merge", "keep_all"])
def test_resolution_of_random_spans_equals_a_plain_version(spark, strategy):
    rng = random.Random(3)
    cases = [spans(*((b := rng.randrange(30), b + rng.randint(1, 9), rng.choice("xyz"), rng.choice("abc"), rng.choice([0.3, 0.5, 0.9])) for _ in range(rng.randrange(9)))) for _ in range(120)]
    got = resolved(spark, cases, strategy, {"a": 1})
    for case, out in zip(cases, got, strict=True):
        if strategy == "keep_all":
            want = sorted(case, key=lambda f: (f["beg"], -f["end"]))
        elif strategy == "merge":
            want, reach = [], -1
            for f in sorted(case, key=lambda f: (f["beg"], -f["end"])):
                if f["beg"] < reach:
                    want[-1]["end"] = max(want[-1]["end"], f["end"])
                else:
                    want.append({**f})
                reach = want[-1]["end"]
        else:
            want = greedy(case, strategy, {"a": 1})
        assert [(f.beg, f.end) for f in out] == [(f["beg"], f["end"]) for f in want]
        if strategy in ("highest_score", "longest"):
            assert [f.detector for f in out] == [f["detector"] for f in want]
    rows = spark.createDataFrame([(str(i), n, f["beg"], f["end"], f["pii_type"], f["detector"], f["score"]) for i, c in enumerate(cases) for n, f in enumerate(c)], "document string, n int, beg int, end int, pii_type string, detector string, score double")
    by = {}
    for r in resolve_rows(rows, strategy, {"a": 1}, order="n").collect():
        by.setdefault(int(r.document), []).append((r.beg, r.end))
    assert {i: sorted(v) for i, v in by.items()} == {i: sorted((f.beg, f.end) for f in out) for i, out in enumerate(got) if out}


RENDERINGS = [
    (Token(), "{{EMAIL}}"), (Token(uppercase=False), "{{email}}"), (Token(prefix="<", suffix=">"), "<EMAIL>"), (Token(include_count=True), "{{EMAIL-0}}"), (Token(include_kind=False, include_count=True), "{{0}}"), (Remove(), ""),
    (Mask(), "*" * 15), (Mask(char="#"), "#" * 15), (Mask(keep_last=4), "***********.com"), (Mask(fixed_length=5), "*****"), (Mask(fixed_length=2, keep_last=3), "**com"), (Mask(keep_last=99), "joe@example.com"),
    (ColumnRenderer(lambda f: F.concat(F.lit("<"), f["pii_type"], F.lit(">"))), "<email>"),
    (Token(include_hash=True, salt="pepper"), "{{EMAIL-" + hashlib.blake2b(b"joe@example.com", key=b"pepper", digest_size=32).hexdigest()[:8].upper() + "}}"),
]


@pytest.mark.parametrize(("renderer", "expected"), RENDERINGS)
def test_rendering(spark, renderer, expected):
    assert Scrubber(detectors=["email"], renderer=renderer).scrub_documents(["to joe@example.com."]).documents.head()["text"] == f"to {expected}."


@pytest.mark.parametrize("make", [
    lambda: Token(include_kind=False), lambda: Token(include_hash=True), lambda: Token(include_hash=True, salt="s", hash_length=0), lambda: Token(include_hash=True, salt=""), lambda: Mask("ab"), lambda: Mask(""), lambda: Mask(keep_last=-1), lambda: Mask(fixed_length=0),
    lambda: Limits(max_chars=0), lambda: parse_locale("english"), lambda: Scrubber(on_detector_error="shrug"), lambda: Finding(0, 0, "", "a", "b"), lambda: Finding(-1, 1, "xx", "a", "b"), lambda: Finding(0, 2, "x", "a", "b"), lambda: Finding(0, 1, "x", "", "b"),
    lambda: Finding(0, 1, "x", "a", "b", 1.5),
])
def test_misuse_is_refused(spark, make):
    with pytest.raises(ValueError):
        make()


def test_findings_of_the_driver():
    a, b = Finding(0, 5, "abcde", "name", "n", context={"x": "y"}), Finding(5, 7, "fg", "email", "e")
    assert not a.overlaps(b) and a.overlaps(b.shift(-1)) and len(a) == 5 and "abcde" not in repr(a) and a == Finding(0, 5, "abcde", "name", "n")
    assert a.to_dict() == {"beg": 0, "end": 5, "pii_type": "name", "detector": "n", "score": 1.0, "context": {"x": "y"}} and b.to_dict(True)["text"] == "fg"


def test_validators(spark):
    rows = [("4111111111111111", 1, 0), ("4111111111111112", 0, 0), ("", 0, 0), ("abc", 0, 0), ("0", 1, 0), ("GB82 WEST 1234 5698 7654 32", 0, 1), ("gb82west12345698765432", 0, 1), ("GB82 WEST 1234 5698 7654 33", 0, 0), ("DE89370400440532013000", 0, 1), ("short", 0, 0)]
    df = spark.createDataFrame(rows, "s string, luhn int, mod97 int")
    for r in df.select("*", validators.luhn(F.col("s")).cast("int").alias("a"), validators.mod97(F.col("s")).cast("int").alias("b")).collect():
        assert (r.a, r.b) == (r.luhn, r.mod97), r.s


def test_ip_grammar_equals_the_standard_library(spark):
    import ipaddress

    rng = random.Random(1)
    texts = ["".join(rng.choice(["", "0", "ff", "1a2b", "12345", ":", ":", "::", "."]) for _ in range(rng.randint(1, 16))) for _ in range(3000)] + [":".join(rng.choice(["", "0", "ff", "1a2b"]) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts += [".".join(str(rng.choice([0, 1, 25, 255, 256, "01"])) for _ in range(4)) for _ in range(500)]

    def valid(t, kind):
        try:
            return isinstance(ipaddress.ip_address(t), kind)
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", validators.ipv4(F.col("t")).alias("v4"), validators.ipv6(F.col("t")).alias("v6")).collect():
        assert r.v4 == valid(r.t, ipaddress.IPv4Address), r.t
        assert r.v6 == (valid(r.t, ipaddress.IPv6Address) and "." not in r.t), r.t


def test_numbers_hold_across_documents_and_runs(spark):
    scrubber = Scrubber(detectors=["email", "ip"], renderer=Token(include_count=True), tokens=TokenMap(keep_originals=True))
    result = scrubber.scrub_documents({"one": "a@b.io and c@d.io", "two": "A@B.IO at 10.0.0.1", "three": None, "four": "x@y.zz c@d.io"})
    assert {r.document: r.text for r in result.documents.collect()} == {"one": "{{EMAIL-0}} and {{EMAIL-1}}", "two": "{{EMAIL-0}} at {{IP-0}}", "three": None, "four": "{{EMAIL-2}} {{EMAIL-1}}"}
    assert result.tokens.original_of("{{EMAIL-0}}") == "A@B.IO" and result.tokens.original_of("{{NO}}") is None
    payload = json.loads(result.tokens.to_json())
    assert payload == {"counts": {"email:a@b.io": 0, "email:c@d.io": 1, "email:x@y.zz": 2, "ip:10.0.0.1": 0}}
    again = Scrubber(detectors=["email"], renderer=Token(include_count=True), tokens=TokenMap.from_dict(spark, payload))
    assert again.scrub_documents(["new@b.io and a@b.io"]).documents.head()["text"] == "{{EMAIL-3}} and {{EMAIL-0}}"
    assert again.clean("q@b.io") == "{{EMAIL-3}}" and again.clean("r@b.io q@b.io") == "{{EMAIL-4}} {{EMAIL-3}}"
    one = Scrubber(detectors=["email"], renderer=Token(include_count=True), tokens=TokenMap(group_key=lambda f: f["pii_type"]))
    assert one.clean("a@b.io c@d.io") == "{{EMAIL-0}} {{EMAIL-0}}"


def test_numbers_do_not_depend_on_how_many_tasks_rank(spark):
    from palimpsest.operators.numbering import number

    rng = random.Random(5)
    mentions = spark.createDataFrame([(f"{k}:{rng.randrange(300)}", k, rng.randrange(1000), rng.randrange(50)) for k in rng.choices(["email", "ip"], [9, 1], k=2000)], "key string, pii_type string, doc_ord long, beg int")
    known = spark.createDataFrame([("email:7", "email", 4), ("ip:1", "ip", 0)], "key string, pii_type string, index long")
    for before in (None, known):
        one, many = ({r.key: r["index"] for r in number(mentions, before, rows_per_task=n).collect()} for n in (10**6, 40))
        assert one == many and len(one) > 300
        for kind in ("email", "ip"):
            own = [i for k, i in one.items() if k.startswith(kind)]
            assert len(own) == len(set(own))


def test_keep_all_replaces_what_comes_first(spark):
    class Wide(PythonDetector):
        name, pii_type = "wide", "wide"

        def find(self, text, document=None):
            if "joe" in text:
                yield self.finding(0, 8, text[:8], document, score=0.2)

    scrubber = Scrubber(detectors=["email", Wide()], strategy="keep_all")
    assert scrubber.scrub_documents(["to: joe@example.com"]).documents.head()["text"] == "{{WIDE}}example.com"
    assert len(scrubber.find("to: joe@example.com")) == 2
    assert Scrubber(detectors=["email", Wide()], min_score=0.5).clean("to: joe@example.com") == "to: {{EMAIL}}"


def failing_class():
    class Failing(PythonDetector):  # local, so that it travels to the workers by value
        name, pii_type = "failing", "x"

        def find(self, text, document=None):
            raise RuntimeError(text)

    return Failing


def test_a_failing_detector(spark):
    Failing = failing_class()
    with pytest.warns(RuntimeWarning, match="failing.*RuntimeError") as caught:
        assert [f.pii_type for f in Scrubber(detectors=["email", Failing()]).find("joe@example.com")] == ["email"]
    assert not any("joe" in str(w.message) for w in caught)
    with pytest.raises(Exception, match="RuntimeError"):
        Scrubber(detectors=["email", Failing()], on_detector_error="raise").find("joe@example.com")
    assert "secret text" not in str(DetectorError("d", "ValueError"))


def test_one_bad_text_takes_no_other_along_and_tables_warn(spark):
    class Fragile(PythonDetector):
        name, pii_type = "fragile", "word"

        def find(self, text, document=None):
            yield self.finding(0, 4, text[:4], document)
            if "bad" in text:
                raise KeyError(text)

    docs = spark.createDataFrame([(i, "bad text" if i == 7 else f"text {i}") for i in range(30)], "id long, text string").coalesce(1)
    scrubber = Scrubber(detectors=[Fragile()])
    with pytest.warns(RuntimeWarning, match="1 texts.*KeyError"):
        result = scrubber.scrub_documents(docs, id_col="id")
    assert sorted(r.text for r in result.documents.collect()) == sorted(["bad text", *(f"{{{{WORD}}}} {i}" for i in range(30) if i != 7)])
    assert [tuple(r) for r in result.failed.collect()] == [("7", 7, "fragile", "KeyError")]
    assert [tuple(r) for r in scrubber.detector_errors(docs.selectExpr("cast(id as string) as document", "id as doc_ord", "text")).collect()] == [("fragile", "KeyError", 1)]


def test_numbers_of_rows_that_share_an_id(spark):
    rows = [(1, "mail a@b.io now"), (1, "mail a@b.io now"), (2, "a long tale c@d.io first then a@b.io"), (2, "c@d.io short"), (None, "a@b.io one"), (None, "longer c@d.io two"), (3, None), (3, "nothing")]
    numbered = Scrubber(detectors=["email"], renderer=Token(include_count=True))
    got = numbered.scrub_documents(spark.createDataFrame(rows, "id long, text string").repartition(3), id_col="id")
    a, c = "{{EMAIL-0}}", "{{EMAIL-1}}"  # null ids come first
    want = [t and t.replace("a@b.io", a).replace("c@d.io", c) for _, t in rows]
    assert sorted(map(str, (r.text for r in got.documents.collect()))) == sorted(map(str, want))
    assert got.documents._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 0
    named = spark.createDataFrame([("x", "c@d.io"), ("w", "a@b.io c@d.io")], "name string, text string")
    assert {r.document: r.text for r in numbered.scrub_documents(named, id_col="name").documents.collect()} == {"w": f"{a} {c}", "x": c}


def test_hashes_equal_the_standard_library(spark):
    texts = ["to joe@example.com and JOE@example.com", "nobody", None, "x@y.io"]
    cleaned = Scrubber(detectors=["email"], renderer=Token(include_hash=True, include_count=True, salt="pepper")).scrub_documents(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), id_col="id")
    tag = lambda t: hashlib.blake2b(t.lower().encode(), key=b"pepper", digest_size=32).hexdigest()[:8].upper()
    joe = "{{EMAIL-0-" + tag("joe@example.com") + "}}"
    assert [r.text for r in cleaned.documents.orderBy("doc_ord").collect()] == [f"to {joe} and {joe}", "nobody", None, "{{EMAIL-1-" + tag("x@y.io") + "}}"]
    plan = Scrubber(detectors=["email"], renderer=Token(include_hash=True, salt="s")).scrub_documents(spark.createDataFrame([(1, "x@y.io")], "id long, text string"), id_col="id").documents
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("text", "found"), [
    ("t eyJhbGciOi.eyJ" + "a" * 1_000_000 + ".c2ln" + "b" * 500 + " end", "eyJhbGciOi.eyJ" + "a" * 1_000_000 + ".c2ln" + "b" * 500),
    ("x-eyJhbGciOi.eyJzdWIiOi.c2lnbmF0", "eyJhbGciOi.eyJzdWIiOi.c2lnbmF0"),
    ("-----BEGIN PRIVATE KEY-----\n" + "a/b+" * 250_000 + "\n-----END PRIVATE KEY-----.", "-----BEGIN PRIVATE KEY-----\n" + "a/b+" * 250_000 + "\n-----END PRIVATE KEY-----"),
    ("password='" + "p w" * 300_000 + "' x", "p w" * 300_000), ("token=" + "q" * 1_000_000, "q" * 1_000_000), ("postgres://u:" + "p" * 100_000 + "@h", "postgres://u:" + "p" * 100_000 + "@"), ("xoxb-" + "1" * 5000, "xoxb-" + "1" * 5000),
    ("-eyJ" * 250_000, None), ("-----BEGIN PRIVATE KEY-----" + "-a" * 400_000, "-----BEGIN PRIVATE KEY-----"), ("-eyJaaaaa" * 20_000 + ".eyJ" + "a" * 800_000, None),
])
def test_secrets_of_any_length_in_linear_time(spark, text, found):
    began = time.time()
    got = Scrubber(detectors=["secret", "password"]).find_documents([text], check=False).collect()
    assert [r.text for r in got] == ([found] if found else []) and time.time() - began < 20


def test_phone_with_a_stand_in_for_the_library(spark, monkeypatch):
    stub = types.ModuleType("phonenumbers")
    stub.Leniency = types.SimpleNamespace(VALID=1, POSSIBLE=0)
    stub.PhoneNumberMatcher = lambda text, region, leniency: [types.SimpleNamespace(start=m.start(), end=m.end(), raw_string=m.group()) for m in re.finditer(r"\+1 \d{3}" if region == "US" else r"\+49 \d{3}", text)]
    monkeypatch.setitem(sys.modules, "phonenumbers", stub)
    from palimpsest.operators.detectors import PhoneDetector

    american, german = PhoneDetector("en_US"), PhoneDetector("de_DE", leniency="possible")
    text = "call +1 555 or +49 301"
    assert [(f.text, f.score) for f in american.find(text)] == [("+1 555", 1.0)] and [(f.beg, f.score) for f in german.find(text)] == [(15, 0.6)]
    assert PhoneDetector(score=0.3, leniency="possible").score == 0.3
    with pytest.raises(ValueError):
        PhoneDetector(leniency="lax")


def test_plugins(spark, monkeypatch):
    from importlib.metadata import EntryPoint

    from palimpsest.operators import registry as module

    points = [EntryPoint(n, v, module.PLUGIN_GROUP) for n, v in (("email", "nowhere:X"), ("badge", "palimpsest.plans.catalogue:Badge"), ("badge", "nowhere:Y"), ("broken", "no_such_package:D"))]
    monkeypatch.setattr(module, "entry_points", lambda group: [p for p in points if p.group == group])
    registry = default_registry()
    assert registry.names()[-2:] == ("badge", "broken") and not registry.entry("badge").autoload and "badge" not in default_registry(plugins=False)
    assert Scrubber(registry=registry, detectors=["badge"]).clean("badge EMP-123456") == "badge {{EMPLOYEE_ID}}"
    with pytest.raises(ImportError):
        registry.load("broken")
    out = run_cli(["list-detectors"])[1]
    assert "badge\topt-in\tplugin\n" in out and out.endswith("\nnot used, the name is taken: email\n") and "phone\topt-in\textra=phone\n" in out


def test_version(capsys):
    with pytest.raises(SystemExit) as caught:
        main(["--version"])
    assert caught.value.code == 0 and capsys.readouterr().out == f"palimpsest {palimpsest.__version__}\n"


def test_limits(spark):
    for limits, texts in ((Limits(max_chars=5), ["abcdef"]), (Limits(max_total_chars=5), ["abc", "def"]), (Limits(max_findings=1), ["a@b.io c@d.io"])):
        with pytest.raises(LimitExceededError):
            Scrubber(limits=limits).scrub_documents(texts)
    assert Scrubber(limits=Limits(max_chars=5)).scrub_documents(spark.createDataFrame([("abcdef",)], "text string")).documents.count() == 1
    fits, rest = Limits(max_chars=3).quarantine(spark.createDataFrame([("abc",), ("abcd",), (None,)], "text string"))
    assert (fits.count(), rest.count()) == (2, 1)


def test_registry(spark):
    Failing = failing_class()
    registry = default_registry()
    assert registry.names()[:8] == ("email", "url", "ip", "credit_card", "iban", "secret", "password", "uuid")
    assert [e.name for e in registry.select("en_US", ["uuid", "email"])] == ["uuid", "email"]
    with pytest.raises(UnknownDetectorError):
        Scrubber(detectors=["nope"])
    with pytest.raises(DuplicateDetectorError):
        registry.register(Failing) and registry.register(Failing)
    assert "failing" not in [e.name for e in registry.select("en_US")]
    registry.set_autoload("failing", True)
    assert "failing" in [e.name for e in registry.copy().select("en_US")]
    registry.remove("failing")
    registry.remove("failing")
    with pytest.raises(UnknownDetectorError):
        registry.remove("failing", missing_ok=False)
    local = Registry([Entry("a", Failing, locales=frozenset({"ru"})), Entry("b", Failing, locales=frozenset({"en_GB"}))])
    assert [[e.name for e in local.select(x)] for x in ("ru_RU", "en-gb", "en_US")] == [["a"], ["b"], []]
    with pytest.raises(MissingDependencyError):
        Registry([Entry("a", "no_such_module:X", extra="thing")]).load("a")
    assert matches_locale("en_US", None) and len(registry) == 9 and "email" in registry


def test_shortcuts_and_replacing_detectors(spark):
    assert clean(TEXT) == "mail {{EMAIL}}, card {{CREDIT_CARD}}"
    assert [(f.beg, f.end, f.pii_type) for f in find(TEXT)] == [(5, 20, "email"), (27, 46, "credit_card")]
    scrubber = Scrubber()
    scrubber.remove_detector("email")
    scrubber.remove_detector("email")
    assert scrubber.clean(TEXT) == "mail joe@example.com, card {{CREDIT_CARD}}"


def run_cli(argv, stdin=TEXT):
    out, err = io.StringIO(), io.StringIO()
    return main(argv, out, err, io.StringIO(stdin)), out.getvalue(), err.getvalue()


@pytest.mark.parametrize(("argv", "expected"), [
    (["clean"], "mail {{EMAIL}}, card {{CREDIT_CARD}}"), (["clean", "--count"], "mail {{EMAIL-0}}, card {{CREDIT_CARD-0}}"), (["clean", "--detectors", "email"], "mail {{EMAIL}}, card 4111 1111 1111 1111"), (["clean", "--detectors", ","], TEXT),
    (["clean", "--renderer", "remove"], "mail , card "), (["clean", "--renderer", "mask", "--mask-char", "#", "--keep-last", "4"], "mail ###########.com, card ###############1111"),
])
def test_cli_clean(spark, argv, expected):
    assert run_cli(argv) == (0, expected, "")


def test_cli_find_and_errors(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("joe@example.com\r\n")
    code, out, _ = run_cli(["find", str(path), "--exit-code"])
    assert code == 1 and out == f"{path}:0-15\temail\t1.00\temail\n"
    lines = [json.loads(x) for x in run_cli(["find", "--json", "--include-text"])[1].splitlines()]
    assert [(x["pii_type"], x["text"]) for x in lines] == [("email", "joe@example.com"), ("credit_card", "4111 1111 1111 1111")] and list(lines[0])[:5] == ["beg", "end", "pii_type", "detector", "score"]
    assert "joe@" not in run_cli(["find"])[1] and run_cli(["find", "--exit-code"], "nothing")[0] == 0
    assert run_cli(["clean", "--detectors", "nope"])[0] == 2 and run_cli(["clean", "no-such-file"])[::2][0] == 2
    assert "email\tdefault" in run_cli(["list-detectors"])[1] and {"name": "uuid", "default": False, "locales": None, "extra": None, "plugin": False} in json.loads(run_cli(["list-detectors", "--json"])[1])
    with pytest.raises(SystemExit):
        main(["nonsense"])
