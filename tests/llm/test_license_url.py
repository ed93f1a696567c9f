from __future__ import annotations

import hashlib
import re

from ledgerloom.llm.license_scan import NOTICES, SPELLINGS, license_scan
from ledgerloom.llm.url_filter import RULES, mined_rules, url_filter

SF = "/root/testdata/sf0.01"


def _notice(words, line):
    """Whether a line is a copyright line: ``words`` is the line from its first letter on."""
    lead = line[: len(line) - len(words)]
    if words.startswith("all rights reserved"):
        return True
    if words.startswith("copyright"):
        rest = words.removeprefix("copyright").lstrip(" \t")
        return rest.startswith(("(c)", "<", "[", "{", ":", "by ")) or rest[:1] in list("0123456789")
    if words.startswith("c)") and lead.endswith("("):
        rest = words.removeprefix("c)").lstrip(" \t")
        return rest.startswith(("copyright", "<", "[", "{")) or rest[:1] in list("0123456789")
    return False


def _canonical(text):
    text = "\n".join(x for x in (text or "").lower().replace("©", "(c)").split("\n") if not _notice(re.sub("^[^a-z]*", "", "\0" + x, count=1), x))
    text = " " + re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", text).strip(" ") + " "
    for a, b in SPELLINGS:
        text = text.replace(f" {a} ", f" {b} ")
    return text.strip(" ")


def _scan(text):
    known = {}
    for name, body in NOTICES:
        known[_canonical(body)] = min(name, known.get(_canonical(body), name))
    found = [known[c] for c in map(_canonical, (text or "").split("\n")) if c in known]
    whole = _canonical(text)
    return known.get(whole), sorted(set(found)), len(found), hashlib.sha256(whole.encode()).hexdigest()


def test_licences_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: tuple(r)[1:] for r in license_scan(docs).collect()}
    assert found == {r.doc_id: _scan(r.text) for r in docs.collect()}
    assert sum(bool(r[1]) for r in found.values()) > 5


def test_licence_odd_rows(spark):
    texts = [
        None, "", "RELEASED under the MIT Licence", "Copyright (c) 2020 Someone\nReleased under\nthe 'MIT' license!", "# Copyright 2020 A\n\n# All rights reserved.",
        "x\nLicensed under CC BY-SA 4.0\nlicensed under cc-by-4.0\nLicensed under CC BY 4.0.", "a " * 50_000 + "\nReleased under the MIT License.",
        "subject to MPL", "© 2001 B\nThis Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
    ]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[2], "c"), (1, texts[2], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    found = sorted((tuple(r) for r in license_scan(df).collect()), key=repr)
    assert found == sorted(((d, *_scan(t)) for d, t, _ in rows), key=repr)
    by = {r[0]: r for r in found if r[0] not in (None, 1)}
    assert by[2][1] == by[3][1] == "MIT" and by[8][1] == "MPL-2.0" and by[5][2] == ["CC-BY-4.0", "CC-BY-SA-4.0"] and by[4][1] is None
    assert license_scan(df.limit(0)).collect() == [] and {r.n_lines for r in license_scan(df, ()).collect()} == {0}


def _split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def _rule(host, path):
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def test_urls_on_whole_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: tuple(r)[1:] for r in url_filter(pages, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    for r in pages.collect():
        host, path = _split(r.url)
        rule, verdict = _rule(host, path)
        assert found[r.page_id][:3] == (host, path, rule)
        assert found[r.page_id][3] == verdict if rule else found[r.page_id][3] in ("allow", "block")


def _fixture(spark):
    urls = [f"http://{'bad' if i % 2 else 'good'}.example.org/{'spam' if i % 4 < 2 else 'news'}/{i}?id={i}" for i in range(400)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    # Bad are the pages of one host in one folder, but for a few.
    labels = [(i, 0 if i % 4 == 1 and i % 40 != 1 else 1, 0) for i in range(300)]
    return urls, pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mined_combinations_against_brute_force(spark):
    from itertools import combinations, product

    from pyspark.sql import functions as F

    from ledgerloom.llm.url_filter import host_and_path, url_tokens

    urls, pages, labels = _fixture(spark)
    host, path = host_and_path("url")
    rows = pages.withColumn("tokens", url_tokens(F.col("url"), host, path))
    sets = {r.page_id: set(r.tokens) for r in rows.collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    n, expected = 300, {}
    for size in range(1, 9):
        for combo in {c for i in range(n) for c in combinations(sorted(sets[i]), size)}:
            inside = [i for i in range(n) if sets[i].issuperset(combo)]
            hits = sum(i in bad for i in inside)
            if hits >= 0.05 * n and hits / len(inside) >= 0.6:
                expected[combo] = round(hits / len(inside), 9)
    rules, classes = mined_rules(rows, labels, 0.05, 0.6)
    alike = {}
    for r in classes.collect():
        alike.setdefault(r["class"], []).append(r.token)
    found = {}
    for r in rules.collect():
        parts = [[c for k in range(1, len(alike[x]) + 1) for c in combinations(alike[x], k)] for x in r.classes]
        found |= {tuple(sorted(sum(chosen, ()))): round(r.confidence, 9) for chosen in product(*parts)}
    assert found == expected and expected and len(expected) > rules.count()
    verdicts = {r.page_id: r.verdict for r in url_filter(pages, labels, support=0.05, confidence=0.6).collect()}
    assert verdicts == {i: "block" if any(s.issuperset(c) for c in expected) else "allow" for i, s in sets.items()}
    assert sum(v == "block" for v in verdicts.values()) == 100


def test_long_hosts_and_paths_of_labelled_pages(spark):
    """Thirty labels and forty folders that stand together are two items, not 2^70 combinations."""
    host, path = ".".join(f"l{chr(97 + i % 26)}{i // 26}" for i in range(30)), "/".join(f"f{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    urls = [f"http://{host}/{path}/x" if i % 3 else f"http://fine.org/{path}" for i in range(60)] + [f"http://{host}/other", "http://fine.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    verdicts = {r.page_id: r.verdict for r in url_filter(pages, labels, confidence=0.9).collect()}
    assert verdicts == {i: "block" if host in u else "allow" for i, u in enumerate(urls)}


def test_url_odd_rows(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "a://b://c.net/fr/", "http://example.net/fr", "http://example.net/fr/", "x://net/es/",
        "x://notcom/", "x://com", "x://com/", "x://com?/", "x://evilexample.com/en/", "x://example.com#/en/", "http://É.COM/en/", "x://a.net:80/fr/", "x://" + "a." * 300 + "net/fr/\n",
    ]
    rows = [(i, u, 0) for i, u in enumerate(urls)] + [(None, urls[4], 0), (1, urls[5], 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")
    labels = spark.createDataFrame([(1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    expected = []
    for i, u, _ in rows:
        host, path = _split(u)
        rule, verdict = _rule(host, path)
        expected.append((i, host, path, rule, verdict or "allow"))
    assert sorted(map(tuple, url_filter(pages, labels).collect()), key=repr) == sorted(expected, key=repr)
    assert url_filter(pages.limit(0), labels).collect() == [] and url_filter(pages, labels.limit(0)).count() == len(rows)
