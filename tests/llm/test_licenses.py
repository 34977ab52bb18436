import random
import re

import pytest

from leafstack.llm.licenses import TEMPLATES, Template, align, increasing, scan_licenses, scan_text
from leafstack.llm.queries.licenses import op5_license_scan

SF = "/root/testdata/sf0.01"


def plain_align(text, template):
    """The definition, recursively and with a quadratic longest increasing subsequence."""
    k = 0
    while k < min(len(text), len(template)) and text[k] == template[k]:
        k += 1
    e = 0
    while e < min(len(text), len(template)) - k and text[-1 - e] == template[-1 - e]:
        e += 1
    out = [(i, i) for i in range(k)] + [(len(text) - 1 - i, len(template) - 1 - i) for i in range(e)]
    t, p = text[k:len(text) - e], template[k:len(template) - e]
    anchors = [(i, p.index(w)) for i, w in enumerate(t) if t.count(w) == 1 and p.count(w) == 1]
    if anchors:
        best = []
        for n, a in enumerate(anchors):
            best.append(max((best[m] for m in range(n) if anchors[m][1] < a[1]), key=len, default=[]) + [a])
        size = max(map(len, best))
        chain = next(b for b in best if len(b) == size)
        return out, k, t, p, size, chain
    return out, k, t, p, 0, []


def test_increasing():
    rng = random.Random(0)
    for _ in range(200):
        v = [rng.randint(0, 20) for _ in range(rng.randint(0, 15))]
        got = [v[k] for k in increasing(v)]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        assert got == sorted(set(got)) and len(got) == max(best, default=0)


def test_align_is_a_common_subsequence_with_all_anchors():
    rng = random.Random(1)
    for _ in range(300):
        template = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))]
        text = [w for w in template if rng.random() < 0.8] if rng.random() < 0.7 else [rng.choice("abcdefghijk") for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 5)):
            text.insert(rng.randint(0, len(text)), rng.choice("xyzab"))
        pairs = align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs[:-1], pairs[1:]))
        ends, _, _, _, size, _ = plain_align(text, template)
        assert set(ends) <= set(pairs) and len(pairs) >= len(ends) + size
    words = list("abcdefgh")
    assert align(words, words) == [(k, k) for k in range(8)]


def test_finds():
    ready = [Template(n, t) for n, t in TEMPLATES.items()]
    for name, text in TEMPLATES.items():
        for data in (text, "Bla der die " * 500 + text.upper() + " und so weiter" * 300, "\n".join("* " + w for w in text.split())):
            got = scan_text(data.encode(), ready)
            assert [g[0] for g in got] == [name] and got[0][1] == 1.0
            a, b = got[0][3:]
            assert re.findall(rb"[a-z0-9]+", data.encode()[a:b].lower()) == re.findall(rb"[a-z0-9]+", text.lower().encode())
    twice = TEMPLATES["MIT"] + "\n" + TEMPLATES["MIT"] + "\nthe of and\n" + TEMPLATES["CC-BY-NC-4.0"]
    assert [g[0] for g in scan_text(twice.encode(), ready)] == ["MIT", "MIT", "CC-BY-NC-4.0"]
    changed = TEMPLATES["MIT-full"].replace("merge, ", "").replace("free of charge", "free of any charge")
    assert [g[0] for g in scan_text(changed.encode(), ready)] == ["MIT-full"]
    assert scan_text(b"the license of under version public", ready) == [] and scan_text(b"", ready) == []


def test_query_finds_what_lines_say(spark):
    out = op5_license_scan(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in out} == set(texts)
    for name in ("Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0", "MIT"):
        want = {i: t.count(TEMPLATES[name]) for i, t in texts.items() if TEMPLATES[name] in t}
        got = [r.doc_id for r in out if r.license == name]
        assert {i: got.count(i) for i in set(got)} == want


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, TEMPLATES["MIT"], "z"), (3, TEMPLATES["MIT"], "z")], "k long, text string, Coverage string")
    out = scan_licenses(df)
    assert out.columns == ["k", "license", "coverage", "matched", "first_byte", "end_byte"]
    assert sorted((r.k, r.license) for r in out.collect() if r.k == 3) == [(3, "MIT")] * 2 and out.count() == 4
    assert scan_licenses(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["MIT"])
def test_own_templates(spark, name):
    df = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "k long, text string")
    assert [r.license for r in scan_licenses(df, templates={"own": "alpha beta gamma delta"}).collect()] == ["own"]


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_runs_of_copies(name):
    """Every copy of a run is found, wherever the run starts."""
    ready, text = [Template(name, TEMPLATES[name])], TEMPLATES[name]
    size = len(ready[0].words)
    for copies in (3, 50):
        for offset in range(size + 1) if copies == 3 else (0, 1, size // 2, size - 1):
            data = "bla " * offset + (text + " ") * copies + "blub" * (offset % 2)
            got = scan_text(data.encode(), ready)
            assert len(got) == copies and all(g[1] == 1.0 for g in got)
            assert [g[3] for g in got] == [4 * offset + k * (len(text) + 1) for k in range(copies)] or text[0] == '"'


def test_neighbours_keep_their_names():
    """Notices that differ by few words, known or not, never get a neighbour's name."""
    ready = [Template(n, t) for n, t in TEMPLATES.items()]
    names = lambda t: [g[0] for g in scan_text(t.encode(), ready)]
    gpl = TEMPLATES["GPL-3.0-header"]
    assert names(gpl.replace("version 3", "version 2")) == ["GPL-2.0-header"]
    assert names(gpl.replace("GNU General", "GNU Affero General")) == ["AGPL-3.0-header"]
    assert names(gpl.replace("GNU General", "GNU Lesser General")) == ["LGPL-3.0-header"]
    assert names(gpl.replace("version 3", "version 2.1").replace("GNU General", "GNU Lesser General")) == ["LGPL-2.1-header"]
    assert names(gpl.replace("version 3", "version 4")) == [] == names(gpl.replace("GNU General", "GNU Library General"))
    assert names(TEMPLATES["BSD-3-Clause"]) == ["BSD-3-Clause"] and names(TEMPLATES["BSD-2-Clause"]) == ["BSD-2-Clause"]
    assert names("This work is licensed under the GNU Affero General Public License, version 3.") == []
    assert names("This work is licensed under the GNU General Public License, version 2.") == []
