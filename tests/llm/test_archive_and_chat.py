import gzip
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from faultline.llm.fixity import OP4_SQL, audit, block_of, changed_record, copy_archive, op4_fixity, read_records, read_tree, write_archive
from faultline.llm import transcripts
from faultline.llm.transcripts import MARKER, best_paths, features, fit, lines_of, marked, op7_transcripts, products, recover_turns

PAGES = "page_id long, url string, html string"
TURNS = "conv_id long, turn long, role string, text string"


def test_audit_equals_sql(spark, tables):
    rows = [(k, f"http://h/{k}", f"<p>page {k} é</p>" * (k % 7 + 1)) for k in range(3000)]
    folder = tables(pages=(rows, PAGES))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    got = list(map(tuple, op4_fixity(spark, folder).collect()))
    assert {r[2] for r in got} == {"changed", "missing", "extra"}
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(con.sql(OP4_SQL).fetchall(), key=key)


def replicas(spark, rows, change, tmp_path, keep=lambda name, record: [record]):
    first, second, third = (f"file://{tmp_path}/{k}" for k in "abc")
    write_archive(spark.createDataFrame(rows, PAGES), first, 16)
    copy_archive(spark, first, second, keep)
    copy_archive(spark, second, third, change)
    return first, second, third


def test_audit_finds_every_kind_and_odd_rows(spark, tmp_path):
    rows = [(k, "u", "x" * k) for k in range(500)] + [(None, "n", "y"), (None, None, None), (7, "u", "x" * 7), (7, "u", "other"), (8, "u", "z" * 300000)] + [(9, "u", "same")] * 100

    def damage(name, record):
        if name == "urn:page:200":
            return []
        if name == "urn:page:20":
            return [changed_record(record, b"!" + block_of(record))]
        return [record, changed_record(record, b"new", ":2")] if name == "urn:page:300" else [record]

    first, second, third = replicas(spark, rows, damage, tmp_path)
    a, b, c = (read_tree(spark, f) for f in (first, second, third))
    assert audit(a, b).count() == 0 and a.where("level = 0").count() == len(rows)
    # one record missing in the middle of a file is one row
    found = sorted((r["record_id"], r["status"]) for r in audit(a, c).collect())
    assert found == [("urn:page:20", "changed"), ("urn:page:200", "missing"), ("urn:page:300:2", "extra")]
    back = {"missing": "extra", "extra": "missing", "changed": "changed"}
    assert sorted((r["record_id"], r["status"]) for r in audit(c, a).collect()) == [(n, back[s]) for n, s in found]
    # offsets are of the unpacked file, members' offsets serve a seek
    for r in audit(a, c).where("status <> 'extra'").collect():
        name = f"{tmp_path}/a/{r['file']}.warc.gz"
        whole = b"".join(x for x, _, _ in read_records("file://" + name))
        with open(name, "rb") as f:
            f.seek(r["member_offset_a"])
            record = gzip.decompress(f.read(r["member_length_a"]))
        assert whole[r["offset_a"] : r["offset_a"] + r["length_a"]] == record and hashlib.sha256(record).hexdigest() == r["hash_a"]
    empty = read_tree(spark, f"file://{tmp_path}/none")
    assert audit(empty, empty).count() == 0 and audit(a, empty).where("status = 'missing'").count() == len(rows) == audit(empty, a).where("status = 'extra'").count()


def test_audit_of_broken_files_and_repeated_ids(spark, tmp_path):
    rows = [(k, "u", f"text {k} " * 50) for k in range(64)] + [(5, "u", "twin one"), (5, "u", "twin two"), (5, "u", "twin two")]
    seen = []

    def lose_one_twin(name, record):
        return [] if block_of(record) == b"twin one" else [record]

    first, second, third = replicas(spark, rows, lose_one_twin, tmp_path)
    a, c = read_tree(spark, first), read_tree(spark, third)
    (r,) = audit(a, c).collect()
    assert (r["record_id"], r["status"], r["length_a"]) == ("urn:page:5", "missing", len(record_like("5", "twin one")))
    # bytes flipped within a member, and a file cut off
    for name, spoil in (("1", lambda x: x[:400] + bytes(20) + x[420:]), ("2", lambda x: x[: len(x) // 2]), ("3", lambda x: b"")):
        path = f"{tmp_path}/b/{name}.warc.gz"
        data = open(path, "rb").read()
        open(path, "wb").write(spoil(data))
    got = audit(a, read_tree(spark, second)).collect()
    seen = {(r["file"], r["status"]) for r in got}
    assert {f for f, _ in seen} == {"1", "2", "3"} and ("3", "missing") in seen
    assert len([r for r in got if r["file"] == "3"]) == 16 and any(r["record_id"] == "unreadable" and r["status"] == "extra" for r in got)


def record_like(page_id, html):
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: u\r\nWARC-Record-ID: <urn:page:{page_id}>\r\nContent-Type: text/html\r\nContent-Length: {len(html)}\r\n\r\n{html}\r\n\r\n"


def test_audit_of_odd_tables(spark, tables):
    assert op4_fixity(spark, tables(pages=([], PAGES))).count() == 0
    rows = [(k, None, None, "a", 1) for k in range(300)]
    got = op4_fixity(spark, tables(pages=(rows, PAGES + ", file string, level int"))).collect()
    assert got and {r["status"] for r in got} <= {"changed", "missing", "extra"}


def conversations(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, 7))):
            role = "system" if t == 0 and c % 5 == 0 else ("user" if t % 2 == 0 else "assistant")
            size = {"system": 6, "user": 8, "assistant": 40}[role]
            lines = ["some words here " * int(rng.integers(1, size)) for _ in range(1 if role != "assistant" else int(rng.integers(1, 5)))]
            rows.append((c, t, role, "\n".join(lines).strip() + ("?" if role == "user" else ".")))
    return rows


def found_roles(turns):
    return {(r["conv_id"], r["start_line"] >> 32): r["role"] for r in turns if r["start_line"] % (1 << 32) == 0}


def test_roles_are_recovered(spark, tables):
    rows = conversations(400)
    folder = tables(conversations=(rows, TURNS))
    got = op7_transcripts(spark, folder).collect()
    roles = found_roles(got)
    bare = {(r["conv_id"], r["turn"]) for r in marked(spark.read.parquet(f"{folder}/conversations.parquet")).where("bare").collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([roles.get(r[:2]) == r[2] for r in held if r[:2] not in bare]) > 0.95
    assert np.mean([roles.get(r[:2]) == r[2] for r in held if r[:2] in bare]) > 0.5
    assert all(r["rendered"].startswith(f"<|{r['role']}|>\n") and r["rendered"].endswith("<|end|>\n") for r in got)
    assert sum(r["n_lines"] for r in got) == sum(len(t.split("\n")) for *_, t in rows)
    # without their markers the turns have the whole texts
    text = "\n".join(r["rendered"].split("\n", 1)[1].removesuffix("<|end|>\n") for r in sorted(got, key=lambda r: (r["conv_id"], r["start_line"])))
    assert text.replace("\n", "") == "".join(t for *_, t in sorted(rows)).replace("\n", "")


def test_unseen_marker_styles(spark):
    """Training has three styles, the transcripts have the fourth."""
    rows = spark.createDataFrame(conversations(300, 1), TURNS)
    for unseen in range(4):
        model = fit(marked(rows, [s for s in range(4) if s != unseen]))
        turns = marked(rows, [unseen])
        roles = found_roles(recover_turns(lines_of(turns), model).collect())
        truth = [(roles.get((r["conv_id"], r["turn"])), r["role"]) for r in turns.where("not bare").collect()]
        assert np.mean([got is not None for got, _ in truth]) > 0.95
        assert np.mean([got == role for got, role in truth]) > 0.85


def brute_turns(rows):
    """Counts, probabilities and paths in plain Python, over whole turns."""

    def seen(line):
        m = re.search(MARKER, line)
        end = line.rstrip(" ")[-1:]
        last = "blank" if not end else "question" if end == "?" else "stop" if end in ".!" else "other"
        return (m[1].lower() if m else ""), min(40, math.floor(2 * math.log2(len(line) + 1))), last

    roles = sorted({r["role"] for r in rows})
    states = [(role, begins) for role in roles for begins in (True, False)]
    counts = [{}, {}, {}]
    start, step = {s: 1e-3 for s in states}, {(s, t): 1e-3 for s in states for t in states}
    learned = {}
    for r in rows:
        if zlib.crc32(str(r["conv_id"]).encode()) % 4 != 2:
            learned.setdefault(r["conv_id"], []).append(r)
    for own in learned.values():
        before = None
        for r in sorted(own, key=lambda r: r["turn"]):
            for k, line in enumerate(r["text"].split("\n")):
                now = (r["role"], k == 0)
                for table, value in zip(counts, seen(line)):
                    table.setdefault(value, dict.fromkeys(states, 0))[now] += 1
                if before is None:
                    start[now] += 1
                else:
                    step[before, now] += 1
                before = now
    for s, t in step:
        if not t[1] and s[0] != t[0]:
            step[s, t] = 1e-12
    start = {s: v if s[1] else 1e-12 for s, v in start.items()}
    total = {s: sum(c[s] for c in counts[0].values()) for s in states}

    def emission(s, line):
        values, out = seen(line), 0.0
        for k, (table, value) in enumerate(zip(counts, values)):
            own = table.get(value, dict.fromkeys(states, 0))[s]
            if k:
                out += math.log((own + 1) / (total[s] + len(table) + 1))
                continue
            sums = {t: total[t] + 0.5 * (len(table) + 2) for t in states}
            group = [t for t in states if t[1] == s[1]]
            free = sum(sums[t] - table.get("", dict.fromkeys(states, 0))[t] - 0.5 for t in group)
            rare = min(0.5, (0.5 + 0.05 * free) / sum(sums[t] for t in group))
            out += math.log((own + 0.5) / sums[s] * (1 - rare)) if value in table else math.log(rare)
        return out

    leave = {s: sum(step[s, t] for t in states) for s in states}
    found = set()
    for conv in sorted({r["conv_id"] for r in rows}):
        lines = [((r["turn"], k), line) for r in sorted(rows, key=lambda r: r["turn"]) if r["conv_id"] == conv for k, line in enumerate(r["text"].split("\n"))]
        score = [{s: emission(s, line) for s in states} for _, line in lines]

        def worth(path):
            out = math.log(start[path[0]] / sum(start.values())) + score[0][path[0]]
            return out + sum(math.log(step[a, b] / leave[a]) + score[k + 1][b] for k, (a, b) in enumerate(zip(path, path[1:])))

        best = max(itertools.product(states, repeat=len(lines)), key=worth)
        opens = [k for k, s in enumerate(best) if s[1]] + [len(lines)]
        for lo, hi in zip(opens, opens[1:]):
            body = [line for _, line in lines[lo:hi]]
            body[0] = re.sub(MARKER + r"\s*", "", body[0], count=1)
            (turn, pos) = lines[lo][0]
            found.add((conv, (turn << 32) + pos, best[lo][0], hi - lo, f"<|{best[lo][0]}|>\n" + "\n".join(body) + "<|end|>\n"))
    return found


def test_query_equals_enumeration(spark, tables):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        for t in range(int(rng.integers(1, 4))):
            role = "user" if t % 2 == 0 else "assistant"
            body = "\n".join("word " * int(rng.integers(1, 6 if t % 2 == 0 else 30)) for _ in range(1 if t % 2 == 0 else int(rng.integers(1, 3))))
            rows.append((c, t, role, body.strip() + ("?" if t % 2 == 0 else ".")))
    folder = tables(conversations=(rows, TURNS))
    turns = marked(spark.read.parquet(f"{folder}/conversations.parquet")).collect()
    assert set(map(tuple, op7_transcripts(spark, folder).collect())) == brute_turns(turns)


def test_paths_equal_enumeration():
    rng = np.random.default_rng(5)
    lengths = [1, 2, 3, 4, 5, 4]
    first = np.cumsum([0, *lengths])
    scores, step, entry = rng.normal(size=(first[-1], 4)), rng.normal(size=(4, 4)), rng.normal(size=(6, 4))
    exits = np.array([-1, 2, -1, 0, -1, 3])
    got = best_paths(scores, first, step, entry, exits)
    model = transcripts.Model(["a", "b"], [], rng.normal(size=4), step)
    whole = products(scores, first, model)
    for i, n in enumerate(lengths):
        own = scores[first[i] : first[i + 1]]
        worth = lambda p, begin: begin[p[0]] + own[np.arange(n), p].sum() + sum(step[a, b] for a, b in zip(p, p[1:]))
        paths = [p for p in itertools.product(range(4), repeat=n) if exits[i] in (-1, p[-1])]
        assert tuple(got[first[i] : first[i + 1]]) == max(paths, key=lambda p: worth(p, entry[i]))
        for row, begin in enumerate([*step, model.start]):
            for end in range(4):
                assert np.isclose(whole[i, row, end], max(worth(p, begin) for p in itertools.product(range(4), repeat=n) if p[-1] == end))


def test_parts_decode_as_the_whole(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"line {t} " * (1 + 9 * (t % 2))) for t in range(400)] + [(2, 0, "user", "hi")]
    turns = marked(spark.createDataFrame(rows, TURNS))
    model, lines = fit(turns), lines_of(turns)
    assert lines.select("part").distinct().count() > 3
    want = recover_turns(lines.withColumn("part", F.lit(0)), model).collect()
    got = recover_turns(lines, model).collect()
    assert sorted(got) == sorted(want) and recover_turns(lines.drop("part"), model).count() == len(want)
    # a turn that goes on over whole parts
    long = spark.createDataFrame([(1, (t << 32), "Human: hello" if not t else "more and more and more") for t in range(300)], "conv_id long, line_no long, line string")
    steps = model.step.copy()
    steps[:, ::2] = -1e6  # nothing but further lines
    never = transcripts.Model(model.roles, model.tables, model.start, steps)
    assert [(r["start_line"], r["n_lines"]) for r in recover_turns(long, never).collect()] == [(0, 300)]


def test_crowded_turns_are_split(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "PART_ROWS", 50)
    turns = conversations(80, 4)
    rows = [(1, 0, role, f"{k} {text}") for k, (_, _, role, text) in enumerate(turns)] + [(1, 0, "user", "same?")] * 3 + [(2, 1, "assistant", "ok")]
    lines = lines_of(marked(spark.createDataFrame(rows, TURNS)))
    assert lines.select("own", "part").distinct().count() > 200
    model = fit(marked(spark.createDataFrame(turns, TURNS)))
    got = recover_turns(lines, model).collect()
    assert sum(r["n_lines"] for r in got) == sum(len(t.split("\n")) for *_, t in rows)
    key = lambda r: (r["conv_id"], r["start_line"], r["role"], r["n_lines"], r["rendered"])
    assert sorted(map(key, got)) == sorted(map(key, recover_turns(lines.withColumn("part", F.lit(0)), model).collect()))


def test_odd_turns(spark, tables):
    rows = [(None, None, None, None), (1, 0, None, "x"), (1, 0, "user", "a\n\nb"), (1, 0, "user", "a\n\nb"), (2, 1, "assistant", ""), (3, 0, "user", "z " * 50000), (4, 0, "assistant", "ok")]
    got = op7_transcripts(spark, tables(conversations=(rows, TURNS))).collect()
    assert sum(r["n_lines"] for r in got) == sum(len((t or "").split("\n")) for *_, t in rows)
    assert op7_transcripts(spark, tables(conversations=([], TURNS))).count() == 0
    assert op7_transcripts(spark, tables(conversations=([(1, 0, None, "x")], TURNS))).count() == 0
    extra = [(*r, 1, "own") for r in conversations(20)]
    assert op7_transcripts(spark, tables(conversations=(extra, TURNS + ", part long, own string"))).count() > 20
