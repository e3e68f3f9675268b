"""Each operator on nulls, blanks, long texts, ties, repeated rows, clashing columns and empty tables, and against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from wattcell.llm import (
    decontaminate,
    embedding_dedup,
    language_id,
    line_dedup,
    minmax_dedup,
    mixing,
    paragraph_dedup,
    tool_chat,
    toxicity,
    url_filter,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, _gone int, copy int, _rest int"
WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r s t l m p".split()]


def sentence(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    base = sentence(1, 60)
    near = base.replace(base.split()[30], "zzz", 1)
    texts = [None, "", "  \t\n", "one", "One", base, base, base.upper(), near, sentence(2, 3000), "a\n\n---\nb", f"{sentence(3, 8)}\n{sentence(4, 60)}",
             f"{sentence(5, 9)} {sentence(4, 60)}\n{sentence(3, 8)}", "!!! ***"]
    out = [(i, t, "en", ("a", "b", None)[i % 3], len(t or ""), 7, "x", 1, 2, 3) for i, t in enumerate(texts)]
    return [*out, out[5], (None, base, None, "a", 3, 7, "x", 1, 2, 3), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def jaccard(a: str | None, b: str | None, n: int) -> float:
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def groups_of(ids: list, linked) -> dict:
    low = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if linked(a, b):
                    low[a] = low[b] = min(low[a], low[b])
    return low


def test_near_documents_match_brute_force(docs, nothing):
    found = minmax_dedup.near_duplicates(docs, gram=2).collect()
    assert len(found) == docs.count()
    texts = {r[0]: r[1] for r in rows() if r[0] is not None}
    low = groups_of(list(texts), lambda a, b: jaccard(texts[a], texts[b], 2) >= 0.8)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"]) == (low[r["doc_id"]], low[r["doc_id"]] == r["doc_id"])
    kept = minmax_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert minmax_dedup.near_duplicates(nothing).count() == 0 and minmax_dedup.drop_near_duplicates(nothing).count() == 0


def test_hot_group_of_near_copies(spark):
    """Hundreds of copies with edits, too different in part: groups as by brute force."""
    base = sentence(11, 60).split()
    texts = []
    for i in range(150):
        draw, w = random.Random(i), list(base)
        for _ in range(draw.randrange(9)):
            w[draw.randrange(len(w))] = f"w{draw.random()}"
        texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minmax_dedup.near_duplicates(frame, gram=2).collect()}
    sets = [{tuple(t.split()[i : i + 2]) for i in range(59)} for t in texts]
    low = list(range(len(texts)))
    linked = [(a, b) for a in low for b in low[:a] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        before = list(low)
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    assert found == dict(enumerate(low))


def test_repeated_passages(docs, nothing, spark):
    found = paragraph_dedup.repeated_passages(docs).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert {6, 7, 8} <= set(by) and not {0, 1, 2, 3, 5, 9, 10} & set(by)
    assert all(r["first_doc_id"] == 5 for r in by[6])
    # Document 12 holds the paragraph of document 11 in the middle of a line of its own.
    twelve = by[12][0]
    assert twelve["first_doc_id"] == 11 and twelve["n_words"] >= 20
    assert paragraph_dedup.repeated_passages(nothing).count() == 0
    # Any run of 49 words or more is found wherever it stands; clean documents are left alone.
    passage = sentence(20, 51)
    planted = [(i, f"{sentence(100 + i, 5 + 7 * i)} {passage} {sentence(200 + i, 40)}") for i in range(12)]
    clean = [(100 + i, sentence(300 + i, 120)) for i in range(12)]
    found = paragraph_dedup.repeated_passages(spark.createDataFrame(planted + clean, "doc_id long, text string"))
    assert {r["doc_id"] for r in found.collect()} == set(range(1, 12))


def _forms(text):
    import re

    return [re.sub(r"[\x00-/:-@\[-`{-\x7f]+", " ", line.lower()).strip() for line in text.split("\n")]


def test_repeated_lines_match_brute_force(spark, docs, nothing):
    base = sentence(31, 40)
    texts = [f"{base}\n{sentence(40, 3)}", f"{sentence(41, 20)}\n{base.upper()}!\n\n***", f"{base[:-1]}x\n{sentence(40, 3)}", base, None, "", f"a b\n{base}\na b"]
    frame = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    marks = {(r["id"], r["line"]): r["simhash"] for r in line_dedup.line_marks(frame, "doc_id", "text").collect()}
    lines = {(i, k): f for i, t in enumerate(texts) if t for k, f in enumerate(_forms(t)) if f}
    assert set(marks) == set(lines)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def linked(a, b):
        if lines[a] == lines[b]:
            return True
        return edits(lines[a], lines[b]) <= 0.2 * max(len(lines[a]), len(lines[b]))

    low = groups_of(sorted(lines), linked)
    report = {r["doc_id"]: r for r in line_dedup.line_report(frame).collect()}
    for i, t in enumerate(texts):
        assert report[i]["removed"] == [k for (d, k) in sorted(lines) if d == i and low[d, k] != (d, k)]
        assert report[i]["n_lines"] == (0 if t is None else len(t.split("\n")))
    left = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(frame).collect()}
    assert left[0]["text"] == texts[0] and left[1]["text"] == f"{sentence(41, 20)}\n\n***" and left[1]["n_chars"] == len(left[1]["text"])
    assert 3 not in left and left[4]["text"] is None and left[5]["text"] == "" and left[6]["text"] == "a b"
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns
    assert line_dedup.line_report(nothing).count() == 0 and line_dedup.drop_repeated_lines(nothing).count() == 0


def test_line_signatures_of_long_lines_and_repeated_rows(spark):
    long = " ".join(sentence(i, 10) for i in range(70))
    frame = spark.createDataFrame([(1, long)] * 300 + [(2, long), (3, "same " * 1000), (4, "--\n \n")], "doc_id long, text string")
    marks = {r["id"]: r for r in line_dedup.line_marks(frame, "doc_id", "text").collect()}
    words = [r["h"] for r in spark.createDataFrame([(w,) for w in _forms(long)[0].split()], "w string").selectExpr("xxhash64(w) AS h").collect()]
    want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in words) > len(words))
    assert set(marks) == {1, 2, 3} and marks[2]["n_words"] == len(words) and marks[1]["n_words"] == 300 * len(words)
    assert marks[1]["simhash"] % 2**64 == marks[2]["simhash"] % 2**64 == want
    assert marks[3]["simhash"] == spark.sql("SELECT xxhash64('same') AS h").first()["h"]


def test_contained_items_match_brute_force(spark, docs, nothing):
    item = sentence(50, 25)
    items = [(0, item), (1, "one two"), (2, None), (3, ""), (None, item), (4, sentence(51, 25)), (0, item)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    broken = item.split()
    broken[12] = "other"
    held = [(0, f"{sentence(52, 3000)} {item.upper()}, {sentence(53, 10)}"), (1, " ".join(broken)), (2, "x ONE-two y"), (3, None), (4, ""), (None, item), (5, sentence(54, 90))]
    frame = spark.createDataFrame([(*h, 1, 2) for h in held], "doc_id long, text string, id int, words int")
    found = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_shingles"]) for r in decontaminate.contained_items(frame, bench).collect()}
    assert found == {(0, 0): (21, 21), (2, 1): (1, 1)}  # five words changed of 21 shingles leave 16, less than 0.8
    left = decontaminate.drop_contaminated(frame, bench)
    assert left.columns == frame.columns and sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 1, 3, 4, 5]
    assert decontaminate.contained_items(nothing, bench).count() == 0
    assert decontaminate.contained_items(frame, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns


def test_mix_meets_targets(spark, docs, nothing):
    frame = spark.createDataFrame([(i, " ".join(["w"] * (1 + i * 37 % 400)), ["a", "b", "c", None][min(i % 6, 3)]) for i in range(3000)], "doc_id long, text string, source string")
    found = mixing.mix(frame, block=64).collect()
    assert sorted(found) == sorted(mixing.mix(frame.repartition(5), block=64).collect())
    total = sum(r["size"] for r in found)
    targets = {r["source"]: (r["source_size"], r["target"]) for r in found}
    assert abs(sum(t for _, t in targets.values()) - 1.5 * total) < 1e-6 * total
    want = {s: 0.0 for s in targets}  # water level by bisection
    names = ["a", "b", "c", None]
    low, high = 0.0, 10.0 * total
    for _ in range(200):
        level = (low + high) / 2
        want = {s: min(2.0 * targets[s][0], level * (5, 2, 1)[k % 3]) for k, s in enumerate(names)}
        low, high = (level, high) if sum(want.values()) < 1.5 * total else (low, level)
    for s, (size, target) in targets.items():
        assert abs(target - want[s]) < 1e-3 * size
        taken = sum(r["taken"] for r in found if r["source"] == s)
        assert abs(taken - target) < 0.01 * target
        copies = [r["copies"] for r in found if r["source"] == s]
        assert abs(sum(copies) - len(copies) * target / size) <= 1 + 1e-6
        assert set(copies) <= {int(target // size), int(target // size) + 1}
    edge = mixing.mix(docs).collect()
    assert len(edge) == docs.count() and all(r["taken"] <= 2 * r["size"] for r in edge)
    assert mixing.mix(nothing).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "_copy"] and mixed.count() == sum(r["copies"] for r in edge)


def test_url_rules(spark):
    urls = ["https://A.Example.NET/en/1?x=1#y", "http://example.net", "x://net/", "http://xnet/", None, "no url", "://example.com/de/", "http://www.example.com/de", "http://shop.example.org/fr/é?", "http://example.net./en/", "http:///en/", "http://net:80/"]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls * 2)], "page_id long, url string, host int, kind int")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("EXAMPLE.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "block"), (None, "/", "block")]
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")

    def brute(url):
        host, path = "", ""
        if url and "://" in url:
            import re

            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.lower()
        fits = [(len(h), len(p), h.lower() + p, v) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    for ranges, parts in ((64, 200_000), (3, 2)):
        found = url_filter.judge(pages, frame, ranges=ranges, rows_per_part=parts).collect()
        assert len(found) == 24
        assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found} == {(i, *brute(u)) for i, u in enumerate(urls * 2)}
    assert url_filter.judge(pages.limit(0), frame).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, frame.limit(0), default="block").collect()} == {"block"}


def test_languages(spark, docs, nothing):
    letters = {"xx": "abcde", "yy": "vwxyz"}
    known = {lang: ["".join(random.Random(f"{lang}{k}").choices(abc, k=7)) for k in range(40)] for lang, abc in letters.items()}

    def text(lang, seed, n):
        draw = random.Random(f"{lang}{seed}")
        return " ".join(draw.choice(known[lang]) for _ in range(n))

    train = [(i, text(lang, i, 60), lang) for i, lang in enumerate(["xx", "yy"] * 40)]
    frame = spark.createDataFrame(train, "doc_id long, text string, lang string")
    learnt = language_id.learn(frame, F.lit(True))
    assert set(learnt) == {"xx", "yy"}
    test = [(1, text("xx", 900, 40)), (2, text("yy", 901, 2000)), (3, None), (4, ""), (5, "12 ."), (None, text("yy", 902, 60)), (1, text("xx", 900, 40))]
    probe = spark.createDataFrame([(*t, 1, "q") for t in test], "doc_id long, text string, id int, lang string")
    found = sorted(map(tuple, language_id.predict(probe, learnt).select("doc_id", "lang_pred").na.fill(-1, ["doc_id"]).collect()))
    assert found == [(-1, "yy"), (1, "xx"), (1, "xx"), (2, "yy"), (3, "und"), (4, "und"), (5, "und")]
    assert all(0 <= r["score"] <= 1 for r in language_id.predict(probe, learnt).collect())
    kept = language_id.drop_unidentified(probe, learnt)
    assert kept.columns == probe.columns and kept.count() == 4
    empty = language_id.learn(nothing, F.lit(True))
    assert empty == {} and {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.drop_unidentified(docs, learnt).columns == docs.columns


def test_toxicity(spark, docs, nothing):
    bad = ["grork", "blarg", "snerx"]

    def text(i, toxic):
        words_ = sentence(1000 + i, 80).split()
        if toxic:
            words_.insert(i % 60, bad[i % 3])
            words_.insert(i * 7 % 60, bad[i % 2])
        return " ".join(words_)

    data = [(i, text(i, i % 5 == 0)) for i in range(900)]
    frame = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.learn(frame, labels, F.col("doc_id") % 3 != 1)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    wrong = [i for i in range(900) if i % 3 == 1 and (scores[i] >= 0.7) != (i % 5 == 0)]
    assert len(wrong) <= 6
    edge = toxicity.score(docs, model).collect()
    assert len(edge) == docs.count() and all(0 <= r["score"] <= 1 for r in edge)
    assert all(r["score"] < 0.7 for r in edge if r["doc_id"] in (0, 1, 2))
    plain = toxicity.learn(nothing, labels, F.lit(True))
    assert plain.weights is None and toxicity.score(nothing, plain).count() == 0


def test_near_vectors_match_brute_force(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    centres = draw.standard_normal((40, 16))
    vectors = [c + draw.standard_normal(16) * s for c in centres for s in (0, 0.15, 0.3, 0.35)] + [centres[0] * 3]
    data = [(i, [float(x) for x in v], 1, 2) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 16, [None, 1.0], [float("nan")] * 16, [float("inf")] * 16, [1e300] * 16, [1.0, 2.0]]
    data += [(500 + i, v, 1, 2) for i, v in enumerate(odd)] + [data[7], (None, data[0][1], 1, 2)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, node int, label int")
    found = embedding_dedup.near_duplicates(frame).collect()
    assert len(found) == len(data)
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    n = close.sum(axis=1) - 1 + close[:, 7]  # vector 7 is there twice
    low = groups_of(list(range(len(vectors))), lambda a, b: close[a, b])
    ones = [i for i in range(len(vectors)) if unit[i].sum() / 4 >= 0.9]  # near the vector of equal large components
    for r in found:
        if r["vec_id"] is not None and r["vec_id"] < 500 and r["vec_id"] not in ones:
            assert (r["n_links"], r["component_id"]) == (n[r["vec_id"]], low[r["vec_id"]])
        elif r["vec_id"] != 506 and r["vec_id"] not in ones:
            assert (r["n_links"], r["component_id"]) == (0, r["vec_id"])
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_tool_messages(spark):
    calls = [
        (1, "a", 0, "find", '{"q": "x", "n": 2}', None), (1, "b", 2, "find", '{"n":1.5,"q":"y"}', "a"), (1, "c", 4, "find", "{bad", "b"),
        (1, "d", 5, "find", '{"z":1}', "zz"), (1, "e", 6, "nope", "{}", "f"), (1, "f", 7, "find", '[1]', "e"), (1, "a", 9, "find", "{}", None),
        (2, "a", 0, "find", '{"q":null}', None), (None, "a", 0, "find", "{}", None), (2, None, 0, "find", "{}", None), (2, "g", 1, None, None, "a"),
    ]
    results = [(1, "a", 1, "one"), (1, "b", 3, None), (1, "q", 8, "lost"), (1, "a", 10, "again"), (None, "a", 1, "")]
    schemas = {"find": {"q": ("string", True), "n": ("integer", False)}}
    a = spark.createDataFrame(calls, "conv long, call_id string, seq long, name string, arguments string, after string")
    b = spark.createDataFrame(results, "conv long, call_id string, seq long, content string")
    found = {(r["conv"], r["call_id"], r["seq"]): (r["kind"], r["level"], r["status"], r["json"]) for r in tool_chat.tool_messages(a, b, schemas).collect()}
    assert found[1, "a", 0] == ("call", 0, "ok", '{"arguments":{"n":2,"q":"x"},"id":"a","name":"find","role":"assistant"}')
    assert found[1, "b", 2][1:3] == (2, "type:n") and found[1, "c", 4][1:3] == (4, "invalid_json,no_result")
    assert '"arguments_text":"{bad"' in found[1, "c", 4][3]
    assert found[1, "d", 5][1:3] == (0, "missing:q,unknown:z,after:missing,no_result")
    assert found[1, "e", 6][1:3] == (None, "unknown_tool,after:cycle,no_result") and found[1, "f", 7][2].startswith("not_an_object")
    assert found[1, "a", 9][1:3] == (None, "repeated") and found[2, "a", 0][2] == "missing:q,no_result"
    assert found[1, "a", 1] == ("result", 1, "ok", '{"content":"one","id":"a","role":"tool"}')
    assert found[1, "b", 3] == ("result", 3, "ok", '{"id":"b","role":"tool"}')
    assert found[1, "q", 8][1:3] == (None, "no_call") and found[1, "a", 10][2] == "repeated" and len(found) == 13
    assert tool_chat.tool_messages(a.limit(0), b.limit(0), schemas).count() == 0
    long = spark.range(300).selectExpr("1 conv", "cast(id as string) call_id", "id seq", "'find' name", "'{}' arguments", "if(id > 0, cast(id - 1 as string), null) after")
    assert tool_chat.levels(long).agg(F.max("level")).first()[0] == 299
