"""The numbered problems: brute force, exact round trips, and nulls, empty tables, ties, repeats and hot keys."""

from __future__ import annotations

import os
import random
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import boilerplate, conversations, leakage, pairs, personal, queries, repeated_lines, scanned, tokens, transcripts

DATA = "/root/testdata/sf0.001"
CHUNK = "point_id string, source string, page int, url string, vendor string, lang string, section string, content_type string, source_type string, chunk_index int, text string, line string, src string"


def chunks(spark, rows):
    keys = [x.split()[0] for x in CHUNK.split(", ")]
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], CHUNK)


def rows_of(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_at_the_smallest_scale(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(repr([r[c] for c in columns]) for r in df.collect())
    assert max(got.values(), default=1) == 1 or not name.endswith("_found")
    if name in queries.oracle_sql():
        cur = db.execute(queries.oracle_sql()[name])
        named = [x[0] for x in cur.description]
        assert sorted(named) == columns
        assert got == Counter(repr([r[named.index(c)] for c in columns]) for r in cur.fetchall())


MESSAGE = "id bigint, session_id string, role string, content string, meta_json string, created_at double, part string"


def test_conversations(spark, tmp_path):
    t = 1.7e9
    rows = [
        (1, "ok", " USER", "q", None, t, "x"), (2, "ok", "bot", "a", None, (t + 5) * 1000, "x"), (3, "ok", "user", "​ ", None, t + 6, "x"),
        (4, "late", "assistant", "a", None, t + 8000, "x"), (5, "late", "user", "q", None, t, "x"), (6, "late", "user", "q", None, t, "x"),
        (7, "open", "user", "q", None, t, "x"), (8, "sys", "system", "s", None, t, "x"), (9, "two", "user", "q", None, t, "x"), (10, "two", "ai", "a", None, t + 4000, "x"), (11, "two", "ai", "b", None, t + 8000, "x"),
        (12, "who", "0", "q", None, t, "x"), (13, "when", "user", "q", None, None, "x"), (14, "lost", "user", "q", None, t, "x"), (15, "lost", "model", "a", None, t + 1, "x"),
        (16, None, "user", "q", None, t, "x"), (17, "tie", "user", "q", None, t, "x"), (18, "tie", "assistant", "a", None, t, "x"), (19, "after", "user", "q", None, t, "x"), (20, "after", "system", "s", None, t + 9000, "x"), (21, "after", "bot", "a", None, t + 9001, "x"), (22, "sysnull", "system", "s", None, None, "x"), (23, "sysnull", "system", "z", None, None, "x"),
    ]
    spark.createDataFrame(rows, MESSAGE).write.parquet(str(tmp_path / "m"))
    sessions = spark.createDataFrame([(s,) for s in ("ok", "late", "open", "sys", "two", "who", "when", "none", "tie", "after", None)], "session_id string")
    got = rows_of(conversations.broken_conversations(spark, str(tmp_path / "m"), sessions))
    assert got == {("open", "missing_reply"), ("sys", "empty"), ("two", "broken"), ("who", "broken"), ("when", "broken"), ("lost", "broken"), ("none", "empty"), ("after", "broken"), ("sysnull", "empty")}
    sound = rows_of(conversations.sound_conversations(spark, str(tmp_path / "m"), sessions).select("session_id", "seq", "role"))
    assert sound == {(s, i, r) for s in ("ok", "late", "tie") for i, r in ((1, "user"), (2, "assistant"))}


def test_conversations_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], MESSAGE).write.parquet(str(tmp_path / "m"))
    assert rows_of(conversations.broken_conversations(spark, str(tmp_path / "m"), spark.createDataFrame([("s",)], "session_id string"))) == {("s", "empty")}


def test_stitching_does_not_depend_on_the_parts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"s{rng.randrange(9)}" if i % 3 else "hot", rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice(["a", "b", "c"]), None, 1.7e9 + rng.randrange(50000), "x") for i in range(400)]
    spark.createDataFrame(rows, MESSAGE).write.parquet(str(tmp_path / "m"))
    sessions = spark.createDataFrame([(f"s{i}",) for i in range(9)] + [("hot",)], "session_id string")
    results = [rows_of(conversations.broken_conversations(spark, str(tmp_path / "m"), sessions, part)) for part in ("10 minutes", "100 days")]
    assert results[0] == results[1]


def _written(spark, rows, path, files):
    spark.createDataFrame(rows, MESSAGE).repartition(files, "id").write.parquet(path)
    return path


def test_conversations_in_any_number_of_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"s{rng.randrange(12)}", rng.choice(["user", "assistant", "assistant", "user", "system", "x"]), rng.choice(["a", "b", "c"]), None, None if i % 97 == 0 else 1.7e9 + rng.randrange(500000), "x") for i in range(300)]
    path = _written(spark, rows, str(tmp_path / "m"), 4)
    (tmp_path / "m_old").mkdir()
    sessions = spark.createDataFrame([(f"s{i}",) for i in range(12)], "session_id string")
    results = [rows_of(conversations.broken_conversations(spark, path, sessions, files_per_batch=n)) for n in (None, 1, 3)]
    assert results[0] == results[1] == results[2] and results[0]


def test_late_messages_inside_and_beyond_the_watermark(spark, tmp_path):
    t = 1.7e9
    first = [(1, "in", "user", "q", None, t, "x"), (2, "out", "user", "q", None, t, "x"), (3, "tick", "user", "q", None, t + 20000, "x")]
    then = [(4, "tick", "assistant", "a", None, t + 20001, "x")]
    late = [(5, "in", "assistant", "a", None, t + 15000, "x"), (6, "out", "assistant", "a", None, t + 5, "x")]
    import os
    import time

    for i, rows in enumerate((first, then, late)):
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
        for f in (tmp_path / "m").glob("*.parquet"):
            if f.stat().st_mtime > time.time() - 1000:
                os.utime(f, (1_600_000_000 + i * 100,) * 2)
    sessions = spark.createDataFrame([("in",), ("out",), ("tick",)], "session_id string")
    got = rows_of(conversations.broken_conversations(spark, str(tmp_path / "m"), sessions, files_per_batch=1, delay="2 hours"))
    assert got == {("out", "missing_reply")}  # its reply came 20,000 seconds late, beyond the watermark of 7,200; that of "in" was in time


def test_pairs(spark):
    q = "How do I set the heat sink on the Corvexa Arc 270?"
    cases = [
        (q, None, "empty"), (q, " ​", "empty"), (q, "(none)", "empty"), (q, "—", "empty"), (q, "N/A", "empty"),
        (q, q, "copied"), (q, "Your question: " + q, "copied"), (q, "do I set the heat sink on the Corvexa Arc 270?", "copied"), (q, f"{q}\n{q}", "copied"), (q, q + "\nTurn the fan by a quarter and wait until the value is stable.", None),
        (q, "I'm sorry, but I can't help with that request. Please ask your dealer instead.", "refusal"), (q, "Unfortunately the old dialog is gone, but there is a new one in the menu.", None), (q, "I can't recommend more than 287 s; stay below it.", None),
        (q, "Turn the fan by a quarter and", "truncated"), (q, "Do it so.\n```\nset a = 1\nset b", "truncated"), (q, "Do it so.\n```\nset a = 1\n```", None), (q, "Clean it. (After a cold start the…", "truncated"), (q, "Values.\n- heat sink: 4 mm\n- dust", "truncated"), (q, "Values.\n- heat sink: 4 mm\n- fan: 3 V", None), (q, "45 mm", None), (q, "No.", None), (q, "See https://docs.corvexa.example/en/1", None),
        (q, "Reinigen Sie die Fläche nur trocken und warten Sie, bis die Anzeige ruhig bleibt.", "other_language"), (q, "", "empty"), (None, "", None), (" ", "", None), (q, "The fan is ok. " * 20000, None),
    ]
    df = spark.createDataFrame([(i, a, b, None, "x") for i, (a, b, _) in enumerate(cases)], "feedback_id bigint, question string, answer string, rating int, first string")
    got = dict(rows_of(pairs.found(df)))
    assert got == {i: d for i, (_, _, d) in enumerate(cases) if d}
    assert pairs.found(df.limit(0)).count() == 0


def test_parser_and_tiling():
    assert pairs.open_at_end("a (b [c)") and not pairs.open_at_end("a (b [c]) „d“ \"e\"")
    assert pairs.open_at_end("<ul><li>a") and not pairs.open_at_end("a<br>b <b>c</b>") and not pairs.open_at_end("```\n( [\n```")
    assert pairs.open_at_end("(<b>text") and not pairs.open_at_end("(<b>text</b>)") and pairs.is_truncated("See:\n1. Open it.\n2.") and not pairs.is_truncated("See:\n- Open it.\n- Close it.")
    assert pairs.is_copy("a b c d", "a b d") and not pairs.is_copy("a b c d", "a b") and not pairs.is_copy("a b c d", "a b c d e f g h i j k l")


def test_long_copies():
    q = " ".join(f"w{i}" for i in range(5000))
    for a, want in ((q, True), ("Re: " + q, True), (q.replace("w77 ", "", 1), True), (q.replace("w77 w78 ", "", 1), False), (q + " more", False), (q.replace("w9 ", "x ", 1), False)):
        assert pairs.is_copy(q, a) == want


def test_copies_at_any_length():
    rng = random.Random(2)
    for n in (5, 199, 200, 201, 400):
        q = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        half = n // 2
        assert pairs.is_copy(" ".join(q), " ".join(q + q)) and pairs.is_copy(" ".join(q), " ".join(q * 6)) and pairs.is_copy(" ".join(q), " ".join(q[half:] + q[:half]))
        assert not pairs.is_copy(" ".join(q), " ".join(q + ["more", "words"])) and not pairs.is_copy(" ".join(q), " ".join(q[: n - 2]))
    import time

    q = [f"w{i % 900}" for i in range(50_000)]
    began = time.time()
    assert pairs.is_copy(" ".join(q), " ".join(q + q)) and time.time() - began < 20


def test_tiles_like_brute_force():
    def plain(q, a, least):
        used, n_used = [False] * len(a), 0
        while True:
            best = max(((n, -j) for j in range(len(a)) for n in range(least, len(a) - j + 1) if not any(used[j : j + n]) and any(q[i : i + n] == a[j : j + n] for i in range(len(q)))), default=None)
            if best is None:
                return n_used
            n, j = best[0], -best[1]
            used[j : j + n] = [True] * n
            n_used += n

    rng = random.Random(6)
    for _ in range(150):
        q, a = ([rng.choice("abcd") for _ in range(rng.randrange(2, 9))] for _ in range(2))
        assert sum(pairs.tiles(q, a, 2)[1]) == plain(q, a, 2)


def test_languages_by_letters():
    profiles = np.zeros((4, pairs.CELLS))
    texts = {"de": "die Fläche reinigen und warten bis der Sensor ruhig bleibt", "en": "clean the surface and wait until the sensor stays quiet", "es": "limpie la superficie y espere hasta que el sensor quede quieto", "fr": "nettoyez la surface et attendez que le capteur reste calme"}
    for i, lang in enumerate(pairs.LANGUAGES):
        np.add.at(profiles[i], pairs._cells([texts[lang]])[0][:-2], 1)
    profiles = pairs.log_shares(profiles * 50)
    got = pairs.other_languages(["clean the surface?"] * 5 + ["Как дела сегодня"], ["die Fläche reinigen", "wait until the sensor stays", "Καλημέρα κόσμε", "45 mm", "espere hasta que quede", "καλημέρα σε όλους"], profiles)
    assert got.tolist() == [True, False, True, False, True, True]
    assert pairs.other_languages([], [], profiles).tolist() == []


def test_many_overlapping_spans(spark):
    text = "Mareth Nerrovich K. Dorvaine, Mareth Nerrovich " * 3000
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = personal.personal_spans(df, spark.createDataFrame([("Mareth",)], "given_name string")).orderBy("start").collect()
    assert len(got) >= 6000 and all(a.stop <= b.start for a, b in zip(got, got[1:], strict=False))


def _page(text, n, source="s.pdf", **more):
    return {"point_id": f"{source}{n}", "source": source, "page": n, "content_type": "text", "source_type": "pdf", "chunk_index": 0, "text": text} | more


def test_scanned_pages(spark):
    words = "the mounting plate and the network switch stay together"
    kinds = ["alpha", "bravo", "carbon", "delta", "echo", "foxtrot"]

    def body(n):
        return f"Keep {kinds[n]} clean: {words}.\nRead {kinds[n]} again: {words}.\nSet {kinds[n]} now: {words}.\nLeave {kinds[n]} off: {words}.\n"

    rows = [_page(f"Acme Handbook 47\n\n{body(n)}- {n + 11} -", n) for n in range(6)]
    rows[2]["text"] = "Acme Handb0ok 47\n\nUse two-\nor three-core cable for the moun-\nting plate and the netw0rk\n" + body(2) + "the network swi~\n- 13 -"
    rows[3]["text"] = "Acme Handbook 47\ntch is new. Code L1O-90\n" + body(3) + "28\nEnd of text\n- 14 -"
    rows += [dict(rows[2])]
    df = chunks(spark, rows + [{"point_id": "n", "source_type": "pdf", "content_type": "text"}])
    got = rows_of(scanned.noisy_lines(df))
    of = lambda p: {(n, k) for i, n, k in got if i == p}
    assert of("s.pdf0") == {(0, "header"), (6, "page_number")}
    assert of("s.pdf2") == {(0, "header"), (3, "hyphen"), (4, "ocr"), (9, "hyphen"), (10, "page_number")}
    assert of("s.pdf3") == {(0, "header"), (8, "page_number")}
    assert scanned.noisy_lines(df.limit(0)).count() == 0
    fixed = " ".join(r.text for r in scanned.repaired(df).where("point_id = 's.pdf2'").orderBy("paragraph_no").collect())
    assert "for the mounting plate and the network Keep carbon" in fixed and fixed.endswith("the network switch") and "Acme" not in fixed


def test_long_lines_and_paragraphs_over_pages(spark):
    body = "the mounting plate and the network switch stay together on the table today."
    pages = [_page(f"{body}\n{body} After the first cold start the operator", 0), _page(f"checks the whole mounting plate again before\nwork goes on. {body}", 1), _page(f"Set it so. {body}", 2)]
    long_line = "plate " * 5_001 + "netw0rk"
    rows = chunks(spark, pages + [_page(long_line + "\nthe network and the network and the network plate", 0, "long.pdf")])
    text = {(r.point_id, r.paragraph_no): r.text for r in scanned.repaired(rows).collect()}
    assert text[("s.pdf0", 0)].endswith("the operator checks the whole mounting plate again before work goes on. " + body) and not any(k[0] == "s.pdf1" for k in text)
    assert text[("s.pdf2", 0)].startswith("Set it so.") and text[("long.pdf0", 0)].count("plate") == 5_002
    assert ("long.pdf0", 0, "ocr") in rows_of(scanned.noisy_lines(rows))


def test_unmarked_breaks_in_a_growing_corpus(spark):
    def corpus(copies):
        text = "Hold the bracket firm. The bracket is new, one bracket a day.\nTurn the brac\nket by hand and read the may\nbe of it, may it be so and may it be bracket.\nmaybe so, maybe not, maybe maybe"
        return [_page(text, 1, f"s{i}-{n}.pdf") for i in range(copies) for n in range(4)]

    got = [{r for r in rows_of(scanned.noisy_lines(chunks(spark, corpus(k)))) if r[2] == "hyphen" and r[0].startswith("s0-")} for k in (1, 10)]
    assert got[0] == got[1] == {(f"s0-{n}.pdf1", 1, "hyphen") for n in range(4)}


def test_skeletons(spark):
    words = [("trocken", "trockeri"), ("route", "roiite"), ("check", "cbeck"), ("Compare", "Cornpare"), ("without", "vvithout"), ("Bezugsebene", "Bezugsebcne"), ("right", "ri9ht"), ("Netzteil", "Netztei1"), ("menu", "rneriii")]
    df = spark.createDataFrame(words, "a string, b string")
    assert all(x == y for x, y in df.select(scanned.skeleton(F.col("a")), scanned.skeleton(F.col("b"))).collect())


def test_repeated_lines_like_brute_force(spark):
    rng = random.Random(1)
    rows = [{"point_id": f"p{i}", "source": f"s{rng.randrange(12)}", "vendor": rng.choice(["A", " a ", "b", None]), "text": rng.choice([None, "", "Legal notice 1\nx%d y" % i, "legal  NOTICE\n\n--\nBody %s" % "abc"[i % 3], "12 34"])} for i in range(200)]
    rows += [dict(rows[3])]
    got = rows_of(repeated_lines.repeated_lines(chunks(spark, rows)))
    import re

    norm = lambda s: " ".join(re.findall(r"[^\W\d_]+", s.lower()))
    sources, seen = {}, {}
    for r in rows:
        if r["vendor"] is not None:
            v = r["vendor"].strip().lower()
            sources.setdefault(v, set()).add(r["source"])
            for i, line in enumerate((r["text"] or "").split("\n") if r["text"] is not None else []):
                if norm(line):
                    seen.setdefault((v, norm(line)), []).append((r["source"], r["point_id"], i))
    want = {(p, i) for (v, _), hits in seen.items() if len({s for s, _, _ in hits}) >= max(3, 0.1 * len(sources[v])) for _, p, i in hits}
    assert got == want
    assert repeated_lines.repeated_lines(chunks(spark, [])).count() == 0


def test_transcripts(spark):
    speakers = spark.createDataFrame([("v", 1, "Mareth Nerrovich"), ("v", 2, "Veylisse Dorvaine"), ("w", 1, None), (None, 1, "A B")], "video_id string, speaker_no int, display_name string")
    cues = [
        (1, "v", 0.0, 1.0, "Before anyone is named"), (2, "v", 2.0, 3.0, "M. Nerrovich : Uhm."), (3, "v", 4.0, 5.0, "The heat sink, right, Veylisse?"), (4, "v", 6.0, 7.0, "[VEYLISSE DORVAINE]"), (5, "v", 8.0, 9.0, "*laughs* 00:00:08 um,"),
        (6, "v", 298.0, 299.0, "is new."), (7, "v", 310.0, 311.0, "is new.\n- Mareth (host): Step 2: go on"), (8, "v", 312.0, 313.0, "and on. >> spk_2: No. Nerrovich, Mareth: Yes."), (9, "v", 312.0, 313.0, "and on. >> spk_2: No. Nerrovich, Mareth: Yes."), (10, "v", 320.0, 319.0, None), (11, "w", 0.0, 1.0, "SPEAKER 1: hello"), (12, None, 0.0, 1.0, "x"), (13, "v", 330.0, 331.0, ""),
    ]
    df = spark.createDataFrame(cues, "cue_id bigint, video_id string, start_seconds double, end_seconds double, text string")
    got = rows_of(transcripts.turn_starts(df, speakers))
    assert got == {("v", 3, 1), ("v", 6, 2), ("v", 7, 1), ("v", 8, 2), ("v", 8, 1), ("w", 11, 1)}
    text = {(r.first_cue_id, r.speaker_no): r.text for r in transcripts.turns(df, speakers).where("video_id = 'v'").collect()}
    assert text[(6, 2)] == "is new." and text[(8, 1)] == "Yes."
    assert transcripts.turn_starts(df.limit(0), speakers).count() == 0
    assert transcripts.turn_starts(df, speakers.limit(0)).count() == 0


def test_turns_are_whole_over_parts(spark):
    speakers = spark.createDataFrame([("v", 1, "Mareth Nerrovich"), ("v", 2, "Veylisse Dorvaine")], "video_id string, speaker_no int, display_name string")
    cues = [(1, "v", 290.0, 291.0, "SPEAKER 1: zebra one"), (2, "v", 299.0, 301.0, "yak two"), (3, "v", 300.0, 302.0, "xenon three"), (4, "v", 950.0, 951.0, "apple four"), (5, "v", 951.0, 952.0, "SPEAKER 2: last")]
    got = transcripts.turns(spark.createDataFrame(cues, "cue_id bigint, video_id string, start_seconds double, end_seconds double, text string"), speakers)
    assert rows_of(got.select("first_cue_id", "speaker_no", "text")) == {(1, 1, "zebra one yak two xenon three apple four"), (5, 2, "last")} and got.count() == 2


def test_viterbi_is_the_best_path():
    import itertools

    tagger = transcripts.Tagger({("start", "speech", ""): 5, ("step", "speech", "speech"): 9, ("step", "speaker", "speech"): 4, ("look", "speaker", "name word"): 3, ("look", "speech", "word"): 9, ("look", "speech", "name end"): 1})
    start, step, look = tagger.logs
    at = {s: i for i, s in enumerate(transcripts.STATES)}
    for kinds in itertools.product(["name", "word", "clock"], repeat=4):
        seen = [tagger.seen[x] for x in transcripts.symbols(kinds)]
        score = lambda p: start[at[p[0]]] + look[at[p[0]], seen[0]] + sum(step[at[a], at[b]] + look[at[b], o] for a, b, o in zip(p, p[1:], seen[1:], strict=False))  # noqa: E731, B023
        best = max(map(score, itertools.product(transcripts.STATES, repeat=4)))
        assert abs(score(tagger.decode(kinds)) - best) < 1e-9


def _by_rule(kinds):
    """What a reader would label: a name belongs to a speaker if only names stand before a colon, role or sign."""
    out = []
    for i, k in enumerate(kinds):
        ahead = next((x for x in kinds[i + 1 :] if x != "name"), "")
        if k in transcripts.CLEAR:
            out.append(transcripts.CLEAR[k])
        elif k in ("sep", "role"):
            out.append("speaker" if out and out[-1] == "speaker" else "speech")
        else:
            out.append("speaker" if ahead in ("namec", "sep", "role") else "speech")
    return out


def test_tagger_on_lines_it_was_not_fitted_on(spark):
    d = DATA.replace("0.001", "0.01")
    named = transcripts.with_names(transcripts.fresh_cues(spark.read.parquet(f"{d}/vtt_cues.parquet")), spark.read.parquet(f"{d}/video_speakers.parquet")).checkpoint()
    tagger = transcripts.Tagger(transcripts.fitted(named, 800))
    rows = named.orderBy(F.xxhash64("video_id", "cue_id"), "cue_id").offset(800).collect()
    seen = [tuple(k for _, k in transcripts.observed(line, transcripts._pairs(r.names))) for r in rows for line in r.lines]
    total = sum(map(len, seen))
    wrong = sum(a != b for kinds in seen for a, b in zip(tagger.decode(kinds), _by_rule(kinds), strict=True))
    assert total > 5000 and wrong <= 0.002 * total


def test_main_body(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        body = [f"The plate {i} meets part {rng.randrange(999)} at the belt.", f"- value: {i} mm", f"Menu > Service > Part > {i}"]
        page = ["Acme stores files on your device.", "Home  Forum  Contact", f"Home » Forum » Title {i} here", f"Title {i} here", body[0], "Tags: a, b%d" % i, *body[1:], f"Get a quote for part {i} today", f"« Part {i}", "1 2 3 … 9", "", "Imprint | Terms"]
        rows.append({"point_id": f"p{i}", "source": f"s{i}", "url": f"https://docs.acme.example/{i}", "vendor": "Acme", "lang": "en", "chunk_index": 0, "text": "\n".join(page)})
    rows += [dict(rows[0]), {"point_id": "x", "source": "x", "text": "Imprint | Terms"}, {"point_id": "y", "url": "u", "source": "y"}]
    got = rows_of(boilerplate.furniture(chunks(spark, rows)))
    assert got == {(f"p{i}", n) for i in range(60) for n in (0, 1, 2, 5, 8, 9, 10, 12)}
    assert boilerplate.furniture(chunks(spark, [])).count() == 0
    kept = {r.point_id: r.text for r in boilerplate.main_body(chunks(spark, rows)).collect()}
    assert kept["p3"].split("\n")[0] == "Title 3 here" and kept["y"] is None and "x" not in kept


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.DEFAULT_VOCABULARY)


def test_tokens_like_the_public_library(encoder):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.DEFAULT_VOCABULARY, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=tokens.SPLIT, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    signs = "abcdeéñß日本 \n\t.,!1234😀​'<|endoftext|>"
    texts = ["", " ", "<|endoftext|>", "a" * 5000, " " * 3000, "xyzzy" * 700] + ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(500)]
    for t in texts:
        assert encoder.ids(t) == reference.encode_ordinary(t)
    assert encoder.ids(None) == []


def test_states_are_shared_and_lookahead_is_bounded():
    t = tokens.MergeTransducer(tokens.DEFAULT_VOCABULARY, max_states=2000)
    words = {b" re" + w + e for w in (b"calibrat", b"organis", b"program", b"connect", b"configur") for e in (b"ion", b"ing", b"ed", b"es", b"able")} | {b" in" + w + b"ing" for w in (b"calibrat", b"organis", b"program", b"connect")}
    for w in words:
        t.encode(w)
    assert len(t.open) < len({w[:i] for w in words for i in range(len(w) + 1)})
    assert t.encode(b"a" * 1_000_000) and len(t.open) <= 2001
    rng = random.Random(9)
    noise = bytes(rng.choice(b"abcdefghij") for _ in range(30_000))
    assert b"".join(t.bytes_of[i] for i in t.encode(noise)) == noise and len(t.open) <= 2001
    assert max(len(w) for _, places in t.open for _, _, w in places) < 20


def test_transducer_survives_clearing():
    small = tokens.MergeTransducer(tokens.DEFAULT_VOCABULARY, max_states=5)
    big = tokens.MergeTransducer(tokens.DEFAULT_VOCABULARY)
    for w in (b"tokenization", b"internationalisation", b"aaaaaaaaaaaaaaaaaaaaaa", bytes(range(256))):
        assert small.encode(w) == big.encode(w)


def test_token_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "naïve 日本 <|endoftext|>", "x"), (3, "naïve 日本 <|endoftext|>", "x")], "doc_id bigint, text string, ids string")
    got = tokens.encode_corpus(df)
    assert [len(r.ids) for r in got.orderBy("doc_id").collect()][:2] == [0, 0] and got.count() == 4
    assert {r[1] for r in got.select("doc_id", tokens.token_text(F.col("ids"))).collect()} == {"", "naïve 日本 <|endoftext|>"}


def test_leaks_like_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    passages = [[word() for _ in range(rng.randrange(8, 40))] for _ in range(30)]
    docs = []
    for i in range(120):
        text = [word() for _ in range(rng.randrange(0, 60))]
        if i % 2:
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text[5:5] = p[a : a + rng.randrange(9, 20)]
        docs.append((i, ", ".join(text).upper(), "x"))
    docs += [(200, None, "x"), (201, "", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, words string")
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)] + [(99, None)], "item_id bigint, passage string")
    grams = lambda ws: {tuple(ws[i : i + 12]) for i in range(len(ws) - 11)}
    want = {(i, j) for i, t, _ in docs for j, p in enumerate(passages) if grams((t or "").lower().replace(",", "").split()) & grams(p)}
    assert rows_of(leakage.leaked_items(d, items)) == want and want
    assert leakage.leaked_items(d.limit(0), items).count() == 0 and leakage.leaked_items(d, items.limit(0)).count() == 0


def test_word_edits_like_a_table():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, (200, 7)), rng.integers(0, 4, (200, 7))
    for x, y, got in zip(a, b, leakage.word_edits(a, b), strict=True):
        row = list(range(8))
        for i, u in enumerate(x):
            row = _edit_row(row, i, u, y)
        assert row[-1] == got


def _edit_row(row, i, u, y):
    now = [i + 1]
    for j, v in enumerate(y):
        now.append(min(row[j + 1] + 1, now[-1] + 1, row[j] + (u != v)))
    return now


def test_walk_keeps_near_windows_together():
    rng = np.random.default_rng(0)
    near = far = 0
    for _ in range(300):
        a = rng.integers(1, 1 << 60, 12)
        b = a.copy()
        b[rng.integers(12)] = 7
        keys = leakage._walk_keys(np.concatenate([a, b, rng.integers(1, 1 << 60, 12)]).astype(np.int64), np.array([0, 12, 24]), leakage.walks_for(leakage.RECALL, leakage.MAX_EDITS, 12), leakage.NEAR_BITS, leakage.NEAR_STEPS)
        near += bool((keys[:, 0] == keys[:, 1]).any())
        far += bool((keys[:, 0] == keys[:, 2]).any())
    assert near > 270 and far == 0


def test_near_leaks_beside_brute_force(spark):
    """The shipped recall, against all pairs of documents and items by edit distance in words, for each kind of edit and size of item."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    cases, docs, items = ["one", "two", "three", "added", "dropped", "short"], [], []
    for i in range(600):
        kind = cases[i % 6]
        size = 8 if kind == "short" else 12
        ws = [word() for _ in range(13)]
        items.append((i, " ".join(ws[:size])))
        at = rng.sample(range(1, size - 1), 3)
        near = ws[:size]
        for j in at[: {"one": 1, "two": 2, "three": 3, "short": 2}.get(kind, 0)]:
            near[j] = word()
        if kind == "added":
            near.insert(at[0], word())
        if kind == "dropped":
            near = near[: at[0]] + near[at[0] + 1 :] + ws[12:]
        docs.append((i, " ".join([word(), *near, word(), word()])))
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    got = {(r.doc_id, r.item_id): r.edits for r in leakage.near_leaks(d, e).collect()}
    assert all(a == b for a, b in got)
    for k, kind in enumerate(cases):
        hits = [got.get((i, i)) for i in range(k, 600, 6)]
        assert sum(x is not None for x in hits) >= 0.9 * len(hits), kind
        assert {x for x in hits if x is not None} <= {"one": {1}, "two": {2}, "three": {3}, "added": {1, 2}, "dropped": {1, 2}, "short": {2}}[kind]


def test_personal_information(spark):
    given = spark.createDataFrame([("Mareth",), ("Kalvane",), (None,)], "given_name string")
    texts = [
        "Please contact Nerrovich, Mareth (+33 1 99 00 96 34) or mareth.n [at] plant-7 [dot] example.", "Signed by KALVANE T. NERROVICH-DORVAINE, passport no. 000-56-4714.", "Call Dreao Nerrovich at (462) 555-0152. Wait 10 ms. After that stop.",
        "Herr Osturne wohnt Am Federweg 16, 00988 Brunnfurt Bitte melden.", "M. Tarnaine a signé le bon. Serial number 4822-22-9252, order 4519-0022, frame 068755501, 10.4.21.7, pin 3@24V.", "Ship to Unit 45, Cooper Quay, Port Lessing ZZ9 9QX.", "K. Dorvaine left. Card 4111 1111 1111 1111 and IBAN DE89 3704 0044 0532 0130 00.", None, "", "Mareth" + " word" * 50000, "Tel 030 23125-250 / 020 7946 0193",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "x")], "doc_id bigint, text string, kind string")
    got = rows_of(personal.personal_items(df, given))
    want = {
        (0, "name", "Nerrovich, Mareth"), (0, "phone", "+33 1 99 00 96 34"), (0, "email", "mareth.n [at] plant-7 [dot] example"), (1, "name", "KALVANE T. NERROVICH-DORVAINE"), (1, "identity_number", "000-56-4714"), (2, "name", "Dreao Nerrovich"), (2, "phone", "(462) 555-0152"),
        (3, "name", "Osturne"), (3, "address", "Am Federweg 16, 00988 Brunnfurt"), (4, "name", "Tarnaine"), (5, "address", "Unit 45, Cooper Quay, Port Lessing ZZ9 9QX"), (6, "name", "K. Dorvaine"), (6, "identity_number", "4111 1111 1111 1111"), (6, "identity_number", "DE89 3704 0044 0532 0130 00"), (10, "phone", "030 23125-250"), (10, "phone", "020 7946 0193"),
    }
    assert got == want
    clean = {r.doc_id: r.text for r in personal.redacted(df, given).collect()}
    assert clean[2] == "Call [NAME] at [PHONE]. Wait 10 ms. After that stop." and clean[7] is None and clean[8] == ""
    assert personal.personal_items(df.limit(0), given).count() == 0
    assert ("name" in {r[1] for r in rows_of(personal.personal_items(df, given.limit(0)))})


def test_checksums():
    assert personal.luhn("4111 1111 1111 1111") and not personal.luhn("4111 1111 1111 1112") and not personal.luhn("0000")
    assert personal._checked("4111 1111 1111 1112") < 0 < personal._checked("4111 1111 1111 1111") and personal._checked("12345678") == 0
    assert personal.mod97("DE89 3704 0044 0532 0130 00") and not personal.mod97("DE89 3704 0044 0532 0130 01")


def test_state_of_conversations_needs_no_package_on_the_worker(tmp_path):
    """The processor can be loaded and used by a Python that can't import the package."""
    from pyspark.serializers import CloudPickleSerializer

    conversations.cloudpickle.register_pickle_by_value(conversations)
    held = tmp_path / "processor"
    held.write_bytes(CloudPickleSerializer().dumps(conversations.Conversation(5)))
    code = f"import pickle; c = pickle.load(open({str(held)!r}, 'rb')); assert c.idle_ms == 5000; assert 'aa' in c.handleInputRows.__globals__['BREAKS']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
