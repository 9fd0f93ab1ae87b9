import itertools
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from corpora import documents, empty, odd_texts, prose
from pyspark.sql import functions as F

from ochre.llm import decontaminate, license_scan, line_windows, queries, url_reputation
from ochre.llm.url_reputation import Rule


def brute_lines(texts):
    seen, out = set(), []
    gone = []
    for t in texts:
        lines = (t or "").split("\n")
        own = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if t is None or not any(x.strip(" ") for x in w):
                continue
            if w in seen:
                own |= {k, k + 1, k + 2}
            seen.add(w)
        gone.append(own)
        out.append(t if not own else "\n".join(x for k, x in enumerate(lines) if k not in own))
    return out, [len(g) for g in gone]


def test_lines(spark):
    r = random.Random(3)
    pool = [prose(r, 4) for _ in range(6)] + ["", " "]
    texts = odd_texts() + ["\n".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(40)] + ["z\nz\nz\nz\nz"]
    rows = line_windows.dedup_lines(documents(spark, texts)).orderBy("doc_id").collect()
    expected, removed = brute_lines(texts)
    assert [r["text"] for r in rows] == expected and [r["n_removed"] for r in rows] == removed
    assert rows[0]["score"] == 0  # other columns stay


def test_lines_of_odd_tables(spark):
    assert line_windows.dedup_lines(empty(spark)).count() == 0
    one = documents(spark, ["a\nb\nc\nd"])
    assert [r["text"] for r in line_windows.dedup_lines(one.unionByName(one)).collect()] == ["a\nb\nc\nd"] * 2


def test_lines_of_long_texts(spark):
    long = "\n".join(f"line {k}" for k in range(50_000))
    texts = ["line 9\nline 10\nline 11\nend", long, "line 49998\nline 49999\nx\ny\n" + long]
    began = time.time()
    rows = line_windows.dedup_lines(documents(spark, texts)).orderBy("doc_id").collect()
    assert time.time() - began < 60  # a split for each line would take minutes
    assert ([r["text"] for r in rows], [r["n_removed"] for r in rows]) == brute_lines(texts)
    assert rows[2]["n_removed"] == 50_000 and rows[1]["n_removed"] == 3


def test_clashing_columns(spark):
    docs = documents(spark, ["a b c d e f g\nb\nc", "x\na b c d e f g\nb\nc"])
    for name in ("_hash", "_starts", "_gone", "at", "n", "h1", "keep"):
        docs = docs.withColumn(name, F.lit(7))
    rows = line_windows.dedup_lines(docs.withColumn("n_lines", F.lit(0))).orderBy("doc_id").collect()
    assert rows[1]["text"] == "x" and rows[1]["_hash"] == rows[1]["keep"] == 7 and rows[1]["n_lines"] == 4
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns and decontaminate.decontaminate(docs, bench).count() == 0


def test_urls(spark):
    r = random.Random(2)
    hosts = ["a.example.com", "b.example.com", "x.example.net", "y.site.co.uk", "com", "z.org"]
    bad_hosts = {"x.example.net"}
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.COM/EN/x", "http://example.com/en/7?x", "http://q.example.com/en/78", "a://b://c/d"] + [f"https://{r.choice(hosts)}/{r.choice(['en', 'de', 'es'])}/{r.randint(1, 90)}{r.choice(['', '?a=b', '#t'])}" for _ in range(400)]
    pages = spark.createDataFrame([(k, u, "h", "x") for k, u in enumerate(urls)], "page_id long, url string, html string, host string").drop("host")
    labels = [(k, int(not (h := re.sub("^.*?://([^/?#]*).*", r"\1", u or "").lower()) in bad_hosts and bool(h)), 0) for k, u in enumerate(urls) if k % 2] + [(3, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    found = url_reputation.judge_urls(pages, table.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), queries.URL_RULES)
    con = duckdb.connect()
    con.register("p", pages.toPandas())
    con.register("l", table.toPandas())
    con.execute("CREATE VIEW pages AS SELECT * FROM p; CREATE VIEW labels AS SELECT doc_id, quality::INTEGER AS quality, toxic::INTEGER AS toxic FROM l")
    told = con.execute(url_reputation.JUDGE_SQL)
    names = [d[0] for d in told.description]
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(told.fetchall()) or sorted(map(str, (tuple(r[n] for n in names) for r in found.collect()))) == sorted(map(str, told.fetchall() or con.execute(url_reputation.JUDGE_SQL).fetchall()))
    by = {r["page_id"]: r for r in found.collect()}
    assert (by[4]["host"], by[4]["path"], by[4]["rule"]) == ("a.example.com", "/EN/x", None) and by[5]["rule"] == by[6]["rule"] == "example.com/en/7" and by[7]["host"] == "b:"
    assert {r["verdict"] for r in by.values() if r["host"] == "x.example.net" and r["rule"] is None} == {"block"}
    assert (by[0]["host"], by[0]["path"], by[0]["verdict"]) == ("", "", "allow")
    none = url_reputation.judge_urls(pages, table.limit(0).select(F.col("doc_id").alias("page_id"), bad.alias("bad")), [Rule("com/", "block")])
    assert {r["verdict"] for r in none.where("rule IS NULL").collect()} == {"allow"}
    assert url_reputation.judge_urls(pages.limit(0), table.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), []).count() == 0


def test_rules_of_the_contract(spark):
    """The words of the contract's list, and verdicts of urls that its rules fit."""
    assert {tuple(r) for r in queries.URL_RULES} == {("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")}
    urls = ["http://x.com/en/1", "http://a.example.com/en/71", "http://net/de/", "http://x.example.net/de/71", "http://x.example.net/de/81", "http://q.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(k, True) for k in range(len(urls))], "page_id long, bad boolean")
    verdicts = {r["page_id"]: r["verdict"] for r in url_reputation.judge_urls(pages, outcomes, queries.URL_RULES).collect()}
    assert [verdicts[k] for k in range(len(urls))] == ["block", "allow", "allow", "allow", "block", "block"]


def test_many_rules_are_joined(spark, monkeypatch):
    r = random.Random(5)
    rules = [Rule(f"{h}{p}", r.choice(["allow", "block"])) for h in ("com", "example.com", "a.example.com", "net", "co.uk") for p in ("/", "/en/", "/en/7", "/de", "/" + "x" * 50)] + [Rule("com/en/", "block"), Rule("com/en/", "allow")]
    urls = [None, "", "nope", "http://com/en/7", "a://A.Example.com/en/77?x", "http://b.example.com/de", "http://example.com" + "/" + "x" * 5000, "http://.com/en/", "http://q.co.uk/", "http://q.co.uk/"] * 2
    urls += [f"https://{r.choice(['a.example.com', 'example.com', 'x.net', 'y.co.uk', 'z.org', 'wexample.com'])}/{r.choice(['en/', 'de', 'en/7', 'x' * 51, ''])}{r.randint(1, 9)}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("_rule", F.lit(1)).withColumn("host", F.lit("q"))
    outcomes = spark.createDataFrame([(k, k % 3 == 0) for k in range(200)], "page_id long, bad boolean")
    few = sorted(map(str, url_reputation.judge_urls(pages, outcomes, rules).collect()))
    monkeypatch.setattr(url_reputation, "INLINE_RULES", 0)
    many = url_reputation.judge_urls(pages, outcomes, rules).collect()
    assert sorted(map(str, many)) == few and len(many) == len(urls) and len({r["rule"] for r in many}) > 10
    lots = rules + [Rule(f"h{k}.org/p{k}", "block") for k in range(3000)]
    assert sorted(map(str, url_reputation.judge_urls(pages, outcomes, lots).collect())) == few


def test_public_suffixes(spark):
    of = lambda host, own: spark.range(1).select(url_reputation.registered_domain(F.lit(host), own).alias("d")).first()["d"]
    assert [of(h, ("co.uk", "a.b.kobe.jp", "b.kobe.jp")) for h in ("x.y.co.uk", "co.uk", "y.com", "q.w.b.kobe.jp", "q.a.b.kobe.jp", "com")] == ["y.co.uk", "co.uk", "y.com", "w.b.kobe.jp", "q.a.b.kobe.jp", "com"]


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_licenses(spark):
    r = random.Random(1)
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    texts = odd_texts() + ["MIT license, CC-BY; cc by\nApache LICENSE gnu general public license GNU General Public License", prose(r, 50) + " " + notice, "licKnse mit lİcense", "cc\u00a0by mit\nlicense", "This work is licensed under the GNU General Public License, version 3."]
    texts += [prose(r, 30) for _ in range(20)]
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        row = rows[k]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == brute_base(text), text
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1
    k = len(odd_texts())
    assert "mit" in rows[k + 1]["labels"].split(",") and "gpl-3.0" in rows[k + 4]["labels"].split(",") and "cc-by-nc" in rows[16]["labels"].split(",")
    assert not rows[k + 10]["labels"]
    assert license_scan.scan_licenses(empty(spark)).count() == 0
    same = documents(spark, ["mit license"])
    assert [r["labels"] for r in license_scan.scan_licenses(same.unionByName(same)).collect()] == ["mit", "mit"]


def test_licenses_of_files_with_many_licence_words(spark):
    r = random.Random(3)
    filler = lambda: prose(r, 12)
    notices = ["licensed under cc by nc 4 0", "released under the mit license", "licensed under the apache license version 2 0", "licensed under the gnu general public license version 3"]
    texts = [" ".join(f"{filler()} {n}" for n in notices) + " " + filler()] * 2
    stray = sorted({w for t in license_scan.TEMPLATES for w in t.text.split()} - license_scan.FUNCTION_WORDS)
    for t in license_scan.TEMPLATES:  # each notice at the end of a long file with all other licence words
        r.shuffle(stray)
        texts.append(" ".join(f"{prose(r, 3)} {w}" for w in stray) + f" {filler()} {t.text} {filler()}")
    texts += [prose(r, 30) for _ in range(40)]
    rows = {row["doc_id"]: row for row in license_scan.scan_licenses(documents(spark, texts)).collect()}
    for k in (0, 1):
        assert {"cc-by-nc", "mit", "apache-2.0", "gpl-3.0"} <= set(rows[k]["labels"].split(",")) and rows[k]["score"] == 1
    for k, t in enumerate(license_scan.TEMPLATES, 2):
        assert t.label in rows[k]["labels"].split(","), t


def told_by_sql(frame):
    con = duckdb.connect()
    con.register("t", frame.select("doc_id", "text").toPandas())
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text FROM t")
    told = con.execute(license_scan.SCAN_SQL)
    names = [d[0] for d in told.description]
    return names, told.fetchall()


def test_licenses_agree_with_sql(spark):
    docs = documents(spark, odd_texts() + [t.text for t in license_scan.TEMPLATES] + ["licKnse mit lİcense", "MIT license " * 3000])
    names, told = told_by_sql(docs)
    assert sorted((tuple(r[n] for n in names) for r in license_scan.scan_licenses(docs).collect()), key=str) == sorted(told, key=str)


def test_every_pair_and_triple_of_licenses(spark):
    r, n = random.Random(4), len(license_scan.TEMPLATES)
    sets = [(k,) for k in range(n)] + list(itertools.combinations(range(n), 2)) + list(itertools.combinations(range(n), 3)) + [tuple(range(n))]
    texts = [f"{prose(r, 7)} " + f" {prose(r, 5)} ".join(license_scan.TEMPLATES[k].text for k in r.sample(own, len(own))) for own in sets]
    rows = license_scan.scan_licenses(documents(spark, texts).withColumn("labels", F.lit(1)).withColumn("w", F.lit(2))).collect()
    assert len(rows) == len(sets)
    for row in rows:
        assert {license_scan.TEMPLATES[k].label for k in sets[row["doc_id"]]} <= set(row["labels"].split(",")), sets[row["doc_id"]]


def brute_alignment(a, b):
    score, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            score[i][j] = max(0, score[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            best = max(best, score[i][j])
    return best


def test_alignment():
    r = random.Random(2)
    for _ in range(300):
        a, b = [r.randint(0, 4) for _ in range(r.randint(1, 12))], [r.randint(0, 4) for _ in range(r.randint(0, 20))]
        score, begin, end = decontaminate.align(np.array(a), np.array(b, dtype=int))
        assert score == brute_alignment(a, b) == brute_alignment(a, b[begin:end])


def word_list(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs_of(words, n):
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def test_contamination(spark):
    r = random.Random(4)
    items = [prose(r, n) for n in (30, 45, 20, 12)] + [None, "", "two words", "?!"]
    edited = items[1].split(" ")
    for k in range(3, len(edited), 9):
        edited[k] = "edited"
    texts = odd_texts() + [prose(r, 200) for _ in range(15)]
    texts += [f"{prose(r, 40)} {items[0].upper()} {prose(r, 20)}", f"{prose(r, 30)} {' '.join(edited)} {prose(r, 30)}", items[2] + " " + items[3], "say two words now"] + [items[0] + " " + prose(r, 9) for _ in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontaminate.contaminated(documents(spark, texts), bench).collect()
    expected = set()
    for k, text in enumerate(texts):
        words = word_list(text)
        for i, item in enumerate(items):
            own = word_list(item)
            if own and (len(own) >= 4 or runs_of(words, len(own)) & runs_of(own, len(own))) and brute_alignment(own, words) >= len(own):
                expected.add((k, i))
    assert {(r["doc_id"], r["item_id"]) for r in rows} == expected
    n = len(odd_texts()) + 15
    assert {(n, 0), (n + 1, 1), (n + 2, 2), (n + 2, 3), (n + 3, 6)} <= expected
    kept = decontaminate.decontaminate(documents(spark, texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {k for k, _ in expected}
    assert kept.columns == documents(spark, texts).columns


def every(words, step, first):
    """``words`` with one word in ``step`` changed."""
    return " ".join(f"changed{k}" if k % step == first else w for k, w in enumerate(words))


def test_contamination_by_edited_copies(spark, monkeypatch):
    r = random.Random(8)
    items = [prose(r, 40) for _ in range(8)]
    copies = [(k, every(item.split(" "), 5 + k % 4, 4)) for k, item in enumerate(items[:6])]  # the only copy of its item
    copies += [(6, items[6])] + [(6, every(items[6].split(" "), 5, 4)) for _ in range(5)]  # edited ones outnumber an exact one
    copies += [(7, " ".join([*items[7].split(" ")[:24], *prose(r, 16).split(" ")])) for _ in range(5)] + [(7, items[7])]
    texts = [f"{prose(r, 25)} {copy} {prose(r, 25)}" for _, copy in copies]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    wanted = {(d, i) for d, text in enumerate(texts) for i, item in enumerate(items) if brute_alignment(word_list(item), word_list(text)) >= len(word_list(item))}
    assert {(d, i) for d, (i, _) in enumerate(copies)} <= wanted
    rows = decontaminate.contaminated(documents(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == wanted
    assert decontaminate.decontaminate(documents(spark, texts), bench).count() == 0
    monkeypatch.setattr(decontaminate, "PART_POSTINGS", 7)  # a few pairs at a time give the same
    found = []
    own = decontaminate.index_items(list(range(8)), items)
    for text in texts:
        words, ends = decontaminate.word_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        places, numbers = decontaminate._gram_places(own, words, ends)
        first, last = np.searchsorted(own.gram, numbers, "left"), np.searchsorted(own.gram, numbers, "right")
        pairs = [(s, q) for spot, posting in decontaminate._parts(places, first, last) for s, q in zip(spot.tolist(), posting.tolist())]
        assert pairs == [(s, q) for s, a, b in zip(places.tolist(), first.tolist(), last.tolist()) for q in range(a, b)]
        found.append(len(pairs))
    assert max(found) > 14


def edited(r, words, share):
    """A copy with a share of words changed, left out, or followed by another."""
    out = []
    for w in words:
        kind = r.choice(["change", "drop", "add"]) if r.random() < share else ""
        out += {"": [w], "change": [f"n{r.randrange(10**6)}"], "drop": [], "add": [w, f"n{r.randrange(10**6)}"]}[kind]
    return out


def recall(spark, r, sizes, share, copies):
    """Of all pairs that score a half or more by alignment alone, the share found."""
    items = [word_list(prose(r, n)) for n in sizes]
    texts = [prose(r, 15) + " " + " ".join(edited(r, item, share)) + " " + prose(r, 15) for item in items for _ in range(copies)] + [prose(r, 60) for _ in range(30)]
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    wanted = {(d, i) for d, text in enumerate(texts) for i, item in enumerate(items) if brute_alignment(item, word_list(text)) >= len(item)}
    rows = decontaminate.contaminated(documents(spark, texts), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in rows} <= wanted and len(wanted) > len(items) * copies / 2
    return len({(x["doc_id"], x["item_id"]) for x in rows}) / len(wanted)


@pytest.mark.parametrize("sizes", [(5, 5, 6, 6, 7, 8), (9, 10, 11, 12, 13, 14), (16, 20, 23, 24, 27, 30)], ids=["short", "middle", "long"])
@pytest.mark.parametrize("share", [0.2, 0.3])
def test_recall_against_all_alignments(spark, sizes, share):
    found = recall(spark, random.Random(11), sizes, share, 8)
    print(f"recall, items of {min(sizes)} to {max(sizes)} words, {share:.0%} edits: {found:.3f}")
    assert found >= 0.9


def test_one_word_in_four_changed(spark):
    """No four words in a row are left."""
    r = random.Random(3)
    item = prose(r, 14).split(" ")
    docs = documents(spark, [" ".join(f"x{k}" if k % 4 == 3 else w for k, w in enumerate(item))])
    rows = decontaminate.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert len(rows) == 1 and rows[0]["score"] > 0.6


def test_seeds_are_rare():
    """Common n-grams, and those that many items share, are no seeds, but enough others are."""
    phrase = "in the middle of the night"
    r = random.Random(5)
    items = [f"{prose(r, 20)} {phrase}" for _ in range(50)]
    own = decontaminate.index_items(list(range(50)), items)
    shared = np.bincount(own.gram, minlength=len(own.grams))
    counts = np.where(shared > 10, 5000, 1)
    kept = decontaminate.rare_seeds(own, counts, 10**6)
    assert set(np.bincount(kept.gram).tolist()) <= set(range(1, 11)) and len(kept.grams) < len(own.grams)
    n = np.diff(own.ends)
    assert (np.bincount(kept.item, minlength=50) >= np.minimum(2 * n // 3 + 1, np.bincount(own.item, minlength=50))).all()
    assert (np.diff(kept.gram) >= 0).all() and kept.gram.max() == len(kept.grams) - 1
    none = decontaminate.rare_seeds(own, np.zeros(len(own.grams), np.int64), 0)
    assert not len(none.grams) and not len(none.gram)


def test_contamination_in_capitals(spark):
    items = ["¿Cuántos años tenía el niño cuando llegó a la montaña según el último capítulo?", "Где находится самое глубокое озеро в мире и какова его глубина", "Ποιος είναι ο μεγαλύτερος ποταμός της Ευρώπης"]
    texts = [f"Bien. {items[0].upper()} Sí.", f"да {items[1].upper()} да", items[2].upper(), items[0].lower(), "nada que ver con los años del niño"]
    bench = spark.createDataFrame([(k, item.upper() if k == 1 else item) for k, item in enumerate(items)], "item_id long, text string")
    rows = decontaminate.contaminated(documents(spark, texts), bench).collect()
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in rows}
    assert set(found) == {(0, 0), (1, 1), (2, 2), (3, 0)} and found[0, 0] == found[1, 1] == found[3, 0] == 1
    assert [r["doc_id"] for r in decontaminate.decontaminate(documents(spark, texts), bench).collect()] == [4]


def test_contamination_of_long_texts(spark, monkeypatch):
    r = random.Random(10)
    item = prose(r, 40)
    long = prose(r, 90_000) + " " + every(item.split(" "), 7, 3) + " " + prose(r, 90_000)
    assert len(long) > 1_000_000
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, [long, prose(r, 50), item])
    rows = decontaminate.contaminated(docs, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in rows} == {(0, 1), (2, 1)} and all(x["start_word"] >= 90_000 for x in rows if x["doc_id"] == 0)
    sent = [x["doc_id"] for x in decontaminate.decontaminate(docs, bench).collect()]
    monkeypatch.setattr(decontaminate, "SENT_BYTES", -1)  # a shuffle in place of the broadcast
    assert [x["doc_id"] for x in decontaminate.decontaminate(docs, bench).collect()] == sent == [1]


def test_contamination_of_odd_tables(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(documents(spark), bench.limit(0)).count() == 0
    same = documents(spark, ["so one two three four five six it is", "clean"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["text"] for r in decontaminate.decontaminate(same.unionByName(same), bench).collect()] == ["clean"] * 2


def test_items_in_blocks(spark, monkeypatch):
    r = random.Random(6)
    items = [prose(r, 25) for _ in range(9)]
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS_BYTES", 400)
    rows = decontaminate.contaminated(documents(spark, items), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in rows) >= Counter((k, k) for k in range(9))
