import random
from itertools import combinations

import pytest

from quillstore.llm import license_scan, url_rules
from quillstore.llm.queries import URL_RULES


def tokens(url):
    if not url or "://" not in url:
        return "", "", set()
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    labels = [x for x in host.split(".") if x]
    return host, path, {"host " + ".".join(labels[i:]) for i in range(len(labels))} | {f"path {i} {x}" for i, x in enumerate(x for x in path.split("/") if x)}


def brute(urls, rules, options):
    parsed = [tokens(u) for u in urls]
    said = []
    for host, path, _ in parsed:
        fit = [(len(h + p), h + p, k) for k, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        said.append(max(fit)[1:] if fit else (None, None))
    rows = [(t, r, k == "block") for (_, _, t), (r, k) in zip(parsed, said, strict=True) if k]
    alike = {}
    for token in {x for t, _, _ in rows for x in t}:
        have = [i for i, (t, _, _) in enumerate(rows) if token in t]
        if sum(rows[i][2] for i in have) >= options.min_count:
            alike.setdefault(tuple(have), set()).add(token)
    good = set()
    for n in (1, 2, 3):
        for c in combinations(alike.values(), n):
            c = frozenset().union(*c)
            have = [(r, b) for t, r, b in rows if t >= c]
            hits = [r for r, b in have if b]
            if len(hits) >= max(1, options.min_count) and len(hits) >= options.min_confidence * len(have) and len(set(hits)) >= options.sources:
                good.add(c)
    return [(h, p, s[0], s[1] or ("block" if any(t.issuperset(c) for c in good) else "allow")) for (h, p, t), s in zip(parsed, said, strict=True)]


def test_against_brute_force(spark):
    urls = [f"http://{s}example.{t}/{lang}/{i % 7}" for i, (s, t, lang) in enumerate((s, t, lang) for s in ("", "www.", "m.", "bad.") for t in ("com", "net", "org") for lang in ("en", "es", "fr"))] * 3
    urls += ["http://promo.es.net/es/1"] * 30 + ["https://promo.es.net/de/2", "HTTP://PROMO.ES.net/de/é", "x", "", None, "a://", "b://H?x/y", "://c.com", "http://c.com#/en/", "http://com/", "http://É.com/en/x://y"]
    urls += ["http://promo.es.net/fr/1"] * 3 + ["http://other.org/" + "/".join(f"s{k}" for k in range(40))] * 3
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    options = url_rules.Options(min_count=5)
    got = sorted(url_rules.judged(pages.repartition(3), URL_RULES, options).collect())
    assert [tuple(r)[1:5] for r in got] == brute(urls, URL_RULES, options)
    assert any(r.matched and r.rule is None for r in got)
    assert url_rules.judged(pages.limit(0), URL_RULES).count() == 0


def test_a_crawl_trap_is_one_item(spark):
    """Forty segments that the same URLs share would be 2 ** 40 patterns."""
    trap = "/".join(f"s{k}" for k in range(40))
    labels = spark.createDataFrame([(f"http://a.org/{trap}/{i}", True) for i in range(60)] + [(f"http://a.org/s0/{i}", False) for i in range(60)], "url string, blocked boolean")
    pages = spark.createDataFrame([(1, f"http://b.org/{trap}/7"), (2, "http://b.org/s0/s2"), (3, "http://b.org/" + "x/" * 20000)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judged(pages, [], labels=labels).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_given_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/casino/1"), (2, "http://b.org/news/1"), (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([(f"http://{h}.org/{p}/{i}", p == "casino") for i, (h, p) in enumerate((h, p) for h in "cdef" for p in ("casino", "news"))] + [(None, None)], "url string, blocked boolean")
    got = {r.page_id: r.verdict for r in url_rules.judged(pages, [], url_rules.Options(min_count=2), labels).collect()}
    assert got == {1: "block", 2: "allow", None: "allow"}


def test_rare_items_of_urls_with_many(spark):
    """A rule of the two items that the fewest blocked URLs have, each of which has fourteen commoner ones that decide nothing."""
    row = lambda r, x, y: "http://h.org/" + "/".join("z" if (r + k) % 17 == 0 else f"a{k}" for k in range(14)) + f"/{x}/{y}"
    labels = [(row(r, "p", "q"), True) for r in range(6)] + [(row(r, f"x{r}", f"y{r}"), True) for r in range(20)]
    labels += [(row(r, *(("p", f"y{r}") if r % 2 else (f"x{r}", "q"))), False) for r in range(40)]
    pages = spark.createDataFrame([(1, row(90, "p", "q")), (2, row(90, "p", "v")), (3, row(90, "v", "q")), (4, row(90, "v", "v"))], "page_id long, url string")
    got = url_rules.judged(pages, [], url_rules.Options(min_count=5), spark.createDataFrame(labels, "url string, blocked boolean")).collect()
    assert {r.page_id: r.matched for r in got} == {1: "path 14 p & path 15 q", 2: None, 3: None, 4: None}


@pytest.mark.parametrize("n,size,width", [(3, 3, 10), (11, 3, 10), (23, 3, 10), (9, 2, 4), (5, 3, 2)])
def test_parts_have_every_combination(n, size, width):
    found = list(map(str, range(n)))
    parts = list(url_rules.covered(found, size, width))
    assert all(len(p) <= max(width, size) for p in parts)
    assert all(any(set(c) <= set(p) for p in parts) for k in range(1, size + 1) for c in combinations(found, k))


@pytest.mark.parametrize("name,text", license_scan.TEMPLATES)
def test_templates_find_themselves(name, text):
    for shown in (text, text.upper(), f"Words before.\n{text}\nWords after it, many of them.", text.replace("under", "under\t")):
        found = license_scan.scan(shown)
        assert [x[1] for x in found][:1] == [name] and found[0][3] == []


def test_differences_and_clean_texts():
    (_, name, _, differing), = license_scan.scan("Released under the permissive MIT License.")
    assert name == "MIT" and differing == ["+permissive"]
    for text in (None, "", "A driving license is needed.", "No words on rights at all", "copyright " * 9):
        assert license_scan.scan(text) == []


def test_words_that_tell_licenses_apart():
    names = lambda text: [x[1] for x in license_scan.scan(text)]
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    assert names(gnu.format("Affero ", "3")) == ["AGPL-3.0"] and names(gnu.format("Lesser ", "2.1")) == ["LGPL-2.1"] and names(gnu.format("Lesser ", "3")) == ["LGPL-3.0"]
    assert names(gnu.format("", "2")) == ["GPL-2.0"] and names(gnu.format("", "3")) == ["GPL-3.0"] and names(gnu.format("", "1")) == []
    assert names(gnu.format("", "3").replace("is licensed", "is not licensed")) == [] and names("It is not licensed under the Apache License, Version 2.0.") == []
    assert names("Licensed under the Apache License, Version 1.1.") == [] and names("Licensed under CC BY 3.0.") == []
    assert names("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.") == ["MPL-2.0"]
    program = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    assert names(program.format("Affero General", "3")) == ["AGPL-3.0"] and names(program.format("Lesser General", "3")) == ["LGPL-3.0"] and names(program.format("General", "2")) == ["GPL-2.0"]
    assert names("word " * 20 + "Released under the MIT License.") == ["MIT"] and names("word " * 130 + "Released under the MIT License.") == ["MIT"]


def test_against_a_plain_matcher():
    """Wordings without a change, planted anywhere among other words, are found where a search for their words finds them, and no others."""
    rng, every = random.Random(4), license_scan.TEMPLATES
    plain = [(name, license_scan.plain(text)) for name, text in every]
    for _ in range(40):
        words = [f"w{rng.randrange(99)}" for _ in range(30)]
        for name, text in rng.sample(every, rng.randrange(0, 4)):
            at = rng.choice([0, len(words), 7])
            words[at:at] = ["end.", *text.split(), "then", "more"]
        shown = " ".join(words)
        found, at = [], 0
        clean = license_scan.plain(shown)
        while at < len(clean):
            here = [(len(t), name) for name, t in plain if clean[at : at + len(t)] == t]
            if here:
                found.append(max(here)[1])
                at += max(here)[0]
            else:
                at += 1
        assert [x[1] for x in license_scan.scan(shown)] == found


def test_every_mention_is_a_candidate():
    """Words before a notice, several notices in a line, texts without line breaks, notices over line breaks."""
    names = lambda text: [x[1] for x in license_scan.scan(text)]
    assert names("This project is released under the MIT License.") == ["MIT"]
    assert names("Copyright (c) 2020 Foo. Licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert names("Released under the MIT License. Licensed under CC BY-NC 4.0.") == ["MIT", "CC-BY-NC-4.0"]
    filler = "some words that go on and on with a license or a copyright in between, "
    long = filler * 40
    for name, text in license_scan.TEMPLATES:
        (start, got, _, differing), = license_scan.scan(long + text + " " + long)
        assert (start, got, differing) == (len(long), name, [])
        assert names(text.replace(" ", "\n")) == [name]
    every = [name for name, _ in license_scan.TEMPLATES]
    assert names(long.join(text + " " for _, text in license_scan.TEMPLATES)) == every
    assert names(" ".join(text for _, text in license_scan.TEMPLATES)) == every
    assert names("copyright " * 20000) == []


def test_ties_go_to_the_longer_then_the_earlier_template():
    """A notice that two templates fit whole: the one of the larger saving, and of more words where both save the same."""
    long = next(t for n, t in license_scan.TEMPLATES if n == "Apache-2.0" and "obtain" in t)
    (start, name, _, differing), = license_scan.scan(long)
    assert (start, name, differing) == (0, "Apache-2.0", [])


def test_scan_rows(spark):
    rows = [(1, "x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", 0), (2, None, 0), (None, "", 0), (1, "y " * 50000 + "\nLicensed under the Apache License, Version 2.0.", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, notices int")
    assert [tuple(r) for r in license_scan.digests(docs).collect()] == [(1, 2, "CC-BY-NC-4.0 MIT", 0), (2, 0, "", 0), (None, 0, "", 0), (1, 1, "Apache-2.0", 0)]
    assert license_scan.digests(docs.limit(0)).count() == 0
