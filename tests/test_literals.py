import re

from faultline.operators import patterns
from faultline.operators.literals import finder, words_of
from faultline.operators.translator import SIGNALS, signals
from faultline.plans.evidence_catalog import SIGNAL_LINES
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

PIECES = ["error", "Disk", "i/o", ".*", r"\d+", "(?:a|full)", "x?", "[ab]c", "(fail|ERR)?", r"\b", "(lost|no\\s+space)", "e+", "(?=k)k", "é", "$"]
TEXTS = ["error", "DISK", "i/o", " ", "42", "full", "a", "ac", "bc", "fail", "lost", "no  space", "k", "É", "é", "\n", "İ"]


def test_words():
    assert words_of("scsi.*(timeout|failed)") == {"timeout", "failed"} or words_of("scsi.*(timeout|failed)") == {"scsi"}
    assert words_of(r"(a|\d)") is None and words_of("[x[y]z") is None and words_of(r"\p{L}abc") is None and words_of("") is None
    assert words_of("ab(cd)?") == {"ab"} and words_of("(ab)+c") == {"ab"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), min_size=1, max_size=4), min_size=1, max_size=6), st.lists(st.sampled_from(TEXTS), max_size=8))
def test_no_match_is_left_out(regexes, parts):
    regexes, text = ["".join(r) for r in regexes], "".join(parts)
    found = finder(regexes)(text)
    assert {k for k, r in enumerate(regexes) if re.search(r, text, re.I | re.A | re.M | re.S)} <= set(found)


def plain(text, rules):
    first = {}
    for k, (code, regex, *_) in enumerate(rules):
        if text is not None and re.search(regex, text, re.I | re.A):
            first.setdefault(code, k)
    return first


def test_all_rules_of_the_registry_fire(spark):
    rows = [(f"t{k}", text) for k, (_, text) in enumerate(SIGNAL_LINES.items())] + [("none", None), ("empty", ""), ("long", "x" * 300_000 + " kernel panic - not syncing")]
    got = {(r["path"], r["code"]): r["rule"] for r in signals(spark.createDataFrame(rows, "path string, text string")).collect()}
    want = {(path, code): k for path, text in rows for code, k in plain(text, SIGNALS).items()}
    assert got == want and {code for _, code in got} == {code for code, *_ in SIGNALS}


def test_plan_does_not_grow_with_rules(spark):
    chunks = spark.createDataFrame([("c", "s", "alpha7 beta9 gamma"), ("d", "s", None), ("e", "s", "word77 word500")], "chunk_id string, log_source string, raw_text string")
    many = {f"P{k}": {"match_any": [f"word{k}\\b", f"alpha{k}.*beta9"], "exclude": ["never"]} for k in range(1000)}
    size = lambda rules: len(re.sub(r"\d+", "", patterns.match(chunks, rules)._jdf.queryExecution().optimizedPlan().toString()))
    assert size(many) == size(dict(list(many.items())[:1]))
    assert sorted((r["chunk_id"], r["pattern_id"], r["confidence"]) for r in patterns.match(chunks, many).collect()) == [("c", "P7", 90), ("e", "P500", 90), ("e", "P77", 90)]


def test_rules_with_all_parts(spark):
    rules = {
        "ALL": {"match_all": ["disk", "full"]},
        "BOTH": {"match_any": ["error", "fault"], "match_all": ["disk", "full"], "device_extract": r"dev (\w+)", "log_sources": ["SYS"]},
        "NOT": {"match_any": [r"\d+"], "exclude": ["quiet"]},
    }
    rows = [(1, "syslog", "Disk FULL error dev sda"), (2, "s", "disk error"), (3, "app", "full disk fault"), (4, None, "7 quiet"), (4, None, "8 ora-00600"), (5, "s", " ")]
    got = patterns.match(spark.createDataFrame(rows, "chunk_id int, log_source string, raw_text string"), rules)
    got = sorted((r["chunk_id"], r["pattern_id"], r["confidence"], r["matched_all"], r["device"], tuple(r["ora_codes"])) for r in got.collect())
    assert got == [(1, "ALL", 100, True, "", ()), (1, "BOTH", 100, True, "sda", ()), (2, "BOTH", 32, False, "", ()), (3, "ALL", 100, True, "", ()), (4, "NOT", 95, False, "", ("ORA-00600",))]
    assert patterns.aggregate(patterns.match(spark.createDataFrame(rows, "chunk_id int, log_source string, raw_text string"), rules)).where(F.col("pattern_id") == "ALL").first()["n_chunks"] == 2


def test_payloads_are_folded_in_order(spark):
    def fold(rows):
        out = {}
        for p, _, conf, n_any, n_all, device, severity, codes in sorted(rows, key=lambda r: (r[0], r[1])):
            if p not in out:
                out[p] = [conf, n_any, n_all, device, severity, codes, 1]
                continue
            o = out[p]
            o[6] += 1
            if conf > o[0]:
                o[0], o[1], o[2], o[3] = conf, n_any, n_all, device or o[3]
        return {(p, *o[:5], tuple(o[5]), o[6]) for p, o in out.items()}

    import random

    r = random.Random(5)
    rows = [(f"P{k % 4}", k, r.randrange(60, 101), k, k % 2 == 0, r.choice(["", "sda", "sdb"]), f"S{k}", [str(k)]) for k in range(120)]
    df = spark.createDataFrame(rows, "pattern_id string, chunk_id int, confidence int, matched_any int, matched_all boolean, device string, severity string, ora_codes array<string>")
    assert {(*t[:6], tuple(t[6]), t[7]) for t in map(tuple, patterns.payloads(df).collect())} == fold(rows)
    assert patterns.payloads(df.limit(0)).collect() == []
