"""Operators on pages and embeddings."""

import gzip
import hashlib
import io
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyarrow import fs

from strandline.llm import vectors, warc, wrapper

PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>x='</p>'</script></head><body><header><a>Site</a></header><nav><ul><li>{0}</li></ul></nav><div class='ad-slot'>buy {0}</div><div id='story'><h2>Head {0}</h2><p>First  {0} &amp; more<br>line<p>Second {0}<ul><li>a{0}<li>b</ul><p>Subscribe now</p></div><div class='comments'><p>reader {0}</p></div><footer>f {0}"


def test_main_text_by_rules():
    want = "Head 7\nFirst 7 & more line\nSecond 7\na7\nb\nSubscribe now"
    assert wrapper.main_text(PAGE.format(7)) == want
    assert wrapper.main_text("<article><h1>T</h1><p>x</p><aside>no</aside></article><p>out</p>") == "T\nx"
    assert wrapper.main_text("") == "" and wrapper.main_text("a &lt; b") == "a < b"
    assert wrapper.main_text("<div>" * 300 + "deep") == "deep"


def plain_wrapper(pages):
    """The wrapper of distinct pages of a host, by plain counting."""
    trees = [wrapper.folded(wrapper.parse(p)) for p in dict.fromkeys(pages)]
    kinds = Counter(map(wrapper.layout, trees))
    text = wrapper.skeleton(sorted(kinds, key=lambda x: (-kinds[x], hashlib.md5(x.encode()).hexdigest()))[: wrapper.LAYOUTS])
    held, whole = {}, wrapper.from_layout(text)
    for tree in trees:
        for p, t in wrapper.matching(tree, whole)[1]:
            held.setdefault(t[2], []).append(p[3])
    counts = []
    for k, v in held.items():
        n, name = max(((n, wrapper.text_name(x)) for x, n in Counter(filter(None, v)).items()), default=(0, 0))
        counts.append((k, len(v), n, sum(map(len, v)), name))
    return wrapper.Wrapper(text, counts)


def test_template_texts_go():
    own = plain_wrapper([f"<div><span>Home of news</span><p>text {i}</p></div>" for i in range(8)])
    assert wrapper.main_text("<div><span>Home of news</span><p>text 99</p></div>", own) == "text 99"


def test_wrappers_match_plain_counting_however_pages_are_dealt(spark):
    """A rare layout's notice is template too, a text on 65 of 100 pages counts as 65, and copies count once."""
    rows = [f"<div><p>own text {i}</p><span>{'often' if i % 100 < 65 else f'seldom {i}'}</span></div>" for i in range(600)]
    rows += [f"<div><h1>Odd {i}</h1><table><tr><td>cell {i}</td></tr></table><em>Rare notice</em></div>" for i in range(7)]
    rows += ["<div><p>copied</p><span>mine</span></div>"] * 900
    table = spark.createDataFrame([(i, "http://h/", page) for i, page in enumerate(rows)], "page_id long, url string, html string")
    own, seen = plain_wrapper(rows), []
    want = {i: wrapper.main_text(page, own) for i, page in enumerate(rows)}
    assert want[3] == "own text 3" and want[99] == "own text 99\nseldom 99" and want[601] == "Odd 1\ncell 1" and want[700] == "copied\nmine"
    for n in (1, 40):
        seen.append({r.page_id: r.text for r in wrapper.main_texts(table.repartition(n, "html", "page_id")).collect()})
    assert seen == [want, want]


def test_joined_wrappers_give_the_same(spark, pages, monkeypatch):
    want = sorted(map(repr, wrapper.main_texts(pages).collect()))
    monkeypatch.setattr(wrapper, "CARRIED", 0)
    assert sorted(map(repr, wrapper.main_texts(pages).collect())) == want


def test_deep_and_long_pages():
    deep = "<div>" * 10_000 + "deep" + "</div>" * 10_000
    assert wrapper.main_text(deep) == "deep"
    own = plain_wrapper([deep.replace("deep", f"deep {i}") for i in range(6)])
    assert wrapper.main_text(deep, own) == "deep"
    long = "<article>" + "".join(f"<p>par {i}</p>" for i in range(50_000)) + "</article>"
    assert wrapper.main_text(long).count("\n") == 49_999


def test_content_stands_where_text_varies():
    """Teasers in articles don't displace a body that stands in a div; an article around the body takes its heading along."""
    body = "<p>The long story of day {0}, told at length {0}</p><p>It goes on and on for {0} hours and more</p>"
    teasers = "<article class='card'><p>more {0}</p></article><article class='card'><p>less {0}</p></article>"
    kinds = {
        f"<html><body><div class='story'>{body}</div><div class='grid'>{teasers}</div></body></html>": f"<div>{body}</div>",
        f"<html><body><article><h1>Day {{0}}</h1><div>{body}</div></article><div><p>odd {{0}}</p></div></body></html>": f"<h1>Day {{0}}</h1>{body}",
        f"<html><body><div class='story'>{body}</div>{teasers}</body></html>": f"<div>{body}</div>",
    }
    for page, content in kinds.items():
        own = plain_wrapper([page.format(i) for i in range(8)])
        assert wrapper.main_text(page.format(99), own) == wrapper.main_text(content.format(99)), page
    both = plain_wrapper([[*kinds][i % 2].format(i) for i in range(16)])  # two layouts of one host
    for page, content in [*kinds.items()][:2]:
        assert wrapper.main_text(page.format(99), both) == wrapper.main_text(content.format(99)), page


def test_matching_is_the_largest_in_order():
    tree = lambda label, *below: [label, list(below), 0, ""]
    a = tree("r", tree("x", tree("y")), tree("z"), tree("x"))
    b = tree("r", tree("z"), tree("x", tree("y")))
    size, pairs = wrapper.matching(a, b)
    assert size[id(a), id(b)] == 3 == len(pairs)
    wrapper.merge(a, b)
    assert wrapper.layout(a) == "0 r\n1 z\n1 x\n2 y\n1 z\n1 x" or wrapper.layout(a) == "0 r\n1 x\n2 y\n1 z\n1 x\n2 y"


def test_every_layout_shapes_the_skeleton(spark, monkeypatch):
    """The notice of a layout that 100 others of its host exceed in frequency is template too, in one merge or in several rounds, carried or joined."""
    name = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    page = "<div><h1>Odd {0}</h1><section class='x{1}'><p>own {0}</p></section><em class='y{1}'>Notice of {1}</em></div>"
    rows = [page.format(f"{k}-{i}", name(k)) for k in range(100) for i in range(8)] + [page.format(f"100-{i}", name(100)) for i in range(6)]
    rows += ["", None] + [page.format(f"few-{i}", "few") for i in range(7)]
    table = spark.createDataFrame([(i, "http://small/" if i > 807 else "http://large/", p) for i, p in enumerate(rows)], "page_id long, url string, html string")
    want = {i: f"Odd {p.split('</h1>')[0][13:]}\nown {p.split('</h1>')[0][13:]}" if p else "" for i, p in enumerate(rows)}
    assert want[805] == "Odd 100-5\nown 100-5" and want[814] == "Odd few-6\nown few-6"
    for layouts, carried in ((wrapper.LAYOUTS, wrapper.CARRIED), (3, wrapper.CARRIED), (3, 0)):
        monkeypatch.setattr(wrapper, "LAYOUTS", layouts)
        monkeypatch.setattr(wrapper, "CARRIED", carried)
        monkeypatch.setattr(wrapper.common, "HOT_ROWS", 2000 if carried else 50)
        got = wrapper.main_texts(table).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want, (layouts, carried)


def test_merging_in_rounds_keeps_every_node(spark):
    """Trees of all layouts align in full with the one tree that rounds of merging leave a host."""
    texts = [wrapper.layout(wrapper.folded(wrapper.parse("<div>" + "".join(f"<{t}><b>x</b></{t}>" for t in kinds) + "</div>"))) for kinds in itertools.permutations(["p", "h2", "ul", "pre", "table"])]
    rows = [("h", 1 + i % 3, text) for i, text in enumerate(texts)] + [("one", 4, texts[7])]
    seen = []
    for n in (1, 9):
        trees = wrapper.common.table(spark.createDataFrame(rows, "host string, n long, layout string").repartition(n), "test")
        seen.append({r.host: r.skeleton for r in wrapper._merged(trees).collect()})
    assert seen[0] == seen[1] and seen[0]["one"] == texts[7] and len(texts) > wrapper.LAYOUTS
    whole, known = wrapper.from_layout(seen[0]["h"]), {}
    for text in texts:
        assert len(wrapper.matching(wrapper.from_layout(text), whole, known)[1]) == text.count("\n") + 1


def test_matching_is_as_large_as_by_the_whole_table():
    draw = random.Random(5)

    def tree(depth):
        return [draw.choice("abc"), [tree(depth - 1) for _ in range(draw.randint(0, 5))] if depth else [], 0, ""]

    def largest(x, y):
        if x[0] != y[0]:
            return 0
        table = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
        for i, c in enumerate(x[1]):
            for j, d in enumerate(y[1]):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + largest(c, d))
        return 1 + table[-1][-1]

    for _ in range(200):
        a, b = tree(3), tree(3)
        pairs = wrapper.matching(a, b)[1]
        assert len(pairs) == largest(a, b) == len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs})


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "x" * 1500 + "</p>"
    rows = [(i, f"http://h{i % 2}.example/a", PAGE.format(i), "k") for i in range(12)]
    rows += [(20, None, big, "k"), (21, "http://h\r\n0/", big, "k"), (22, "", big, "k"), (22, "", big, "k"), (23, "x", None, "k"), (24, "x", "", "k"), (25, "x", "é", "k"), (26, "x", "é", "k"), (None, "x", big, "k")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def test_main_texts(pages):
    rows = wrapper.main_texts(pages).collect()
    assert len(rows) == pages.count()
    text = {r.page_id: r.text for r in rows}
    assert text[3].startswith("Head 3\nFirst 3 & more line\nSecond 3\na3") and "reader" not in text[3] and "buy" not in text[3]
    assert text[23] == text[24] == "" and text[25] == "é" and all(r.n_chars == len(r.text) for r in rows)
    assert wrapper.main_texts(pages.limit(0)).count() == 0


def test_archives(spark, pages, tmp_path):
    rows = warc.through_archives(pages, str(tmp_path / "w")).collect()
    assert len(rows) == pages.count()
    by_id = {r.page_id: r for r in rows}
    for r in pages.collect():
        own = (r.html or "").encode()
        got = by_id[r.page_id]
        assert (got.payload_bytes, got.payload_digest) == (len(own), hashlib.sha1(own).hexdigest())
    assert by_id[22].record_type == "response" and [by_id[i].refers_to for i in (20, 21, None)] == [22, 22, 22]
    assert by_id[25].record_type == by_id[26].record_type == "response" and by_id[25].refers_to is None
    files = [p for p in (tmp_path / "w" / "members").iterdir() if p.suffix == ".gz"]
    total = 0
    for p in files:
        data = p.read_bytes()
        for line in p.with_name(p.name + ".idx").read_text().splitlines():
            at, n, kind, name = line.split("\t")
            member = gzip.decompress(data[int(at) : int(at) + int(n)])
            assert member.startswith(b"WARC/1.1\r\n") and name.encode() in member and kind.encode() in member
            total += 1
    assert total == pages.count()
    assert warc.through_archives(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_normaliser_streams_any_cut(tmp_path):
    parts = [warc.record(i, "u", b"\r\n\r\n" * i + b"z" * (i * 70_000), hashlib.sha1(b"").hexdigest(), "response", None, 4 * i + i * 70_000) for i in range(6)]
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"".join(parts[:4])) + gzip.compress(b"".join(parts[4:])))
    assert warc.normalise(fs.LocalFileSystem(), str(tmp_path / "a.gz"), str(tmp_path / "b.gz")) == 6
    assert gzip.decompress((tmp_path / "b.gz").read_bytes()) == b"".join(parts)
    assert list(warc.records(iter([b"".join(parts)[i : i + 7] for i in range(0, 3000, 7)][:0]))) == []
    with pytest.raises(ValueError):
        list(warc.inflated(io.BytesIO(gzip.compress(b"x" * 100)[:-9])))


def test_near_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = np.repeat(base, 5, 0) + rng.normal(size=(300, 16)) * rng.choice([0.05, 0.2, 0.35], (300, 1))
    rows[10] = rows[11] = rows[12]
    table = [(i, [float(np.float32(x)) for x in r], i % 3 if i % 50 else 0, "x") for i, r in enumerate(rows)]
    odd = [(1000, None, 0, "x"), (1001, [0.0] * 16, 0, "x"), (1002, [float("nan")] + [1.0] * 15, 0, "x"), (1003, table[3][1], None, "x"), (1004, [1.0, None], 0, "x"), (1005, [1.0, 2.0], 0, "x"), (1006, [], 0, "x"), table[30], (None, table[5][1], 2, "x")]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<float>, label int, links string")
    got = vectors.near_vectors(df).collect()
    assert len(got) == len(table) + len(odd)
    data = vectors.unit(np.array([t[1] for t in [*table, table[30]]]))
    ids, label = np.array([t[0] for t in [*table, table[30]]]), np.array([t[2] for t in [*table, table[30]]])
    link = (data @ data.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    top = ids.copy()
    for _ in range(50):
        top = np.minimum(top, np.where(link, top[None], 10**6).min(1))
    found = {r.vec_id: r for r in got}
    true = sum(link.sum(1))
    assert sum(r.n_links for r in got) >= 0.9 * true
    exact = [found[i].n_links == n and found[i].component_id == t for i, n, t in zip(ids.tolist(), link.sum(1), top, strict=True)]
    assert np.mean(exact) > 0.97 and all(found[i].n_links <= n for i, n in zip(ids.tolist(), link.sum(1), strict=True))
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in range(1000, 1007))
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("dimension", "codes"), [(64, 35), (64, 256), (256, 35), (256, 256)])
def test_recall_of_the_grid(dimension, codes):
    """Held-out vectors turned to the threshold's cosine meet their origin in a visited cell, from one end or the other."""
    rng = np.random.default_rng(dimension + codes)
    grid = vectors.Grid(vectors.unit(rng.normal(size=(8000, dimension))), codes, 0.93)
    own = vectors.unit(rng.normal(size=(2000, dimension)))
    turn = rng.normal(size=own.shape)
    turn = vectors.unit(turn - (turn * own).sum(1, keepdims=True) * own)
    other = 0.93 * own + np.sqrt(1 - 0.93**2) * turn
    met = np.zeros(len(own), bool)
    for a, b in ((own, other), (other, own)):
        row, cell = grid.visits(*grid.halves(a))
        first, second = (x.argmin(1) for x in grid.halves(b))
        met |= np.isin(np.arange(len(own)), row[cell == (first * grid.codes[1].shape[0] + second)[row]])
    assert met.mean() >= 0.9


def test_visits_come_in_all_cells_within_the_limit():
    rng = np.random.default_rng(1)
    grid = vectors.Grid(vectors.unit(rng.normal(size=(400, 8))), 6, 0.93)
    first, second = grid.halves(vectors.unit(rng.normal(size=(50, 8))))
    row, cell = grid.visits(first, second)
    assert len({*zip(row.tolist(), cell.tolist(), strict=True)}) == len(row)
    for i in range(50):
        cost = (first[i][:, None] + second[i][None]).ravel()
        assert set(cell[row == i].tolist()) == set(np.flatnonzero(cost <= grid.limit).tolist()) | {int(cost.argmin())}
        assert cell[row == i][0] == cost.argmin()
