"""Operators on documents: edge cases, and plain versions to compare with."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import common, licenses, media, mixing, ngramjoin, packing, substring, toxicity, words

SMALL = "/root/testdata/sf0.001"


def payload(text):
    own = (text or "").encode()
    return own + b"\0" * (max(64, -(-len(own) // 64) * 64) - len(own))


def test_words_match_plain_splitting():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aB é\n\t.0–") for _ in range(rnd.randrange(40))) for _ in range(300)] + [None, "x" * 50]
    for lo, hi, raw, offs in words.slices(pa.array(texts), 200):
        start, stop, row = words.spans(raw, offs, words.space_table())
        got = defaultdict(list)
        for a, b, r in zip(start, stop, row, strict=True):
            got[lo + r].append(raw[a:b].tobytes().decode())
        for i in range(lo, hi):
            assert got[i] == re.findall("[^\x20\x09-\x0d]+", texts[i] or "")


def test_media_round_trip():
    rnd = random.Random(3)
    kinds = ([0], [0] * 30 + [1, 255, 128], [0, 1, 255, 2], range(256), range(97, 123))
    own = [bytes(rnd.choice(k) for _ in range(64 * n)) for k in kinds for n in (1, 7, 60)]
    files = media.encode(own)
    back = media.decode(files, tensors=True)
    assert [x["payload"] for x in back] == own
    assert all(x["rgb"].shape == (x["height"], x["width"], 3) for x in back)
    again = media.decode(files[::-1])[::-1]
    assert [x["feature"] for x in again] == [x["feature"] for x in back]  # whatever the neighbours


def test_media_is_a_jpeg_for_others(spark):
    """The JVM's own decoder agrees on size and, within a step, on a gray block."""
    data = media.encode([bytes([40]) + bytes(63)])[0]
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    assert (image.getWidth(), image.getHeight()) == (16, 16)
    rgb = media.decode([data], True)[0]["rgb"]
    shown = image.getRGB(2, 2)
    assert all(abs(int(rgb[2, 2, i]) - (shown >> (16 - 8 * i) & 255)) <= 2 for i in range(3))


def test_media_scales_by_the_quantisation_table(spark):
    own = bytes([40]) + bytes(63)
    data = media.encode([own])[0]
    at = data.index(b"\xff\xdb") + 5
    five = data[:at] + b"\x05" * 64 + data[at + 64 :]
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(five))
    plain, scaled = media.decode([data, five], True)
    assert scaled["payload"] == plain["payload"] == own and scaled["feature"] != plain["feature"]
    shown = image.getRGB(2, 2)
    assert all(abs(int(scaled["rgb"][2, 2, i]) - (shown >> (16 - 8 * i) & 255)) <= 2 for i in range(3))
    sizes = data.index(b"\xff\xc2") + 5
    with pytest.raises(ValueError):
        media.decode([data[:sizes] + b"\x00\x0f" + data[sizes + 2 :]])


def test_features_are_those_of_the_tensors(edge):
    for r in media.stored_and_read(edge).collect():
        shown = np.frombuffer(r.rgb, np.uint8).reshape(-1, 3).astype(np.float64)
        assert len(shown) == r.width * r.height
        assert r.feature == f"{r.width}x{r.height};" + ",".join(f"{x:.3f}" for x in (*shown.mean(0), *shown.std(0)))


def test_media_query(edge, empty):
    rows = media.stored_and_read(edge).collect()
    texts = {r.doc_id: r.text for r in edge.collect()}
    assert len(rows) == edge.count()
    for r in rows:
        own = payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((texts[r.doc_id] or "").encode()), len(own), hashlib.sha256(own).hexdigest())
        assert r.tail_crc32 == zlib.crc32(own[-64:])
    assert media.stored_and_read(empty).count() == 0
    tensor = media.read(media.stored(edge.where("doc_id = 4")), tensors=True).first()
    assert len(tensor.rgb) == tensor.width * tensor.height * 3 and tensor.payload == payload(texts[4])


def test_licences_match_plain_scan(spark, edge, empty):
    more = ["Released under the MIT License.", "LICENSED under the Apache License, Version 2.0 cc by-nc cc by nc", "This work is licensed under the GNU General Public License, version 3.", "the the license mit under"]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: r for r in licenses.licences(docs).collect()}
    for key, r in rows.items():
        n, places = licenses.plain_scan(texts[key])
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert [rows[100 + i].labels for i in range(4)] == ["mit", "apache-2,cc-by-nc", "gpl-3", ""]
    assert licenses.licences(empty).count() == 0


def test_licences_of_a_notice_with_all_templates(spark):
    whole = "\n\n".join(text for _, text, _ in licenses.TEMPLATES)
    hot = " ".join(word for _, text, _ in licenses.TEMPLATES for word in text.split()[::-1])
    docs = spark.createDataFrame([(0, whole), (1, hot + "\n" + whole), (2, "plain words")], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.licences(docs).collect()}
    labels = ",".join(sorted({label for label, _, _ in licenses.TEMPLATES}))
    assert (rows[0].labels, rows[0].score) == (labels, 1.0) and (rows[1].labels, rows[1].score) == (labels, 1.0) and rows[2].labels == ""


def plain_licences(texts):
    """(labels, score) of each text, every alignment of every template tried."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = {key: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low)) for key, t in texts.items()}
    held = Counter(w for ws in own.values() for w in set(ws))
    out = {}
    for key, ws in own.items():
        named = {label for _, label in licenses.plain_scan(texts[key])[1]}
        score = float(bool(named))
        for label, text, phrases in licenses.TEMPLATES:
            template = text.split()
            rare = sorted(set(template), key=lambda w: (-math.log((len(own) + 1) / (held[w] + 0.5)), int(licenses.hashed(w)[0])))[: licenses.RARE]
            keys = [(next(q for q in range(len(template)) if template[q:][: len(p)] == p), p) for p in map(str.split, phrases)]
            for at in range(-len(template) + 1, len(ws)):
                same = [w for q, w in enumerate(template) if 0 <= at + q < len(ws) and ws[at + q] == w]
                near = range(-licenses.SLACK, licenses.SLACK + 1)
                if len(set(same) & set(rare)) >= licenses.VOTES and all(any(at + q + s >= 0 and ws[at + q + s : at + q + s + len(p)] == p for s in near) for q, p in keys):
                    named.add(label)
                    score = max(score, len(same) / len(template))
        out[key] = (",".join(sorted(named)), score)
    return out


def test_licences_match_every_alignment(spark, edge):
    """Whole and damaged notices, of words that are rare or common in the table, in texts of other words."""
    rnd, rows = random.Random(21), []
    vocabulary = sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()}) + [f"w{i}" for i in range(60)]
    for i in range(160):
        own = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 40))]
        for _ in range(rnd.randrange(0, 4)):
            notice = rnd.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rnd.randrange(0, 3)):
                q = rnd.randrange(len(notice))
                notice[q : q + rnd.randrange(0, 2)] = rnd.choice([[], ["x"], ["License"]])
            at = rnd.randrange(len(own) + 1)
            own[at:at] = notice
        rows.append((1000 + i, rnd.choice([" ", ", ", "\n"]).join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge.select("doc_id", "text").where("length(text) < 100 or text is null").dropDuplicates(["doc_id"]))
    want = plain_licences({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: (r.labels, r.score) for r in licenses.licences(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want) and len({v for v, _ in want.values()}) > 20


def plain_units(text):
    """(start, words) of the units of a text, by the rule in words."""
    low, out = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), []
    at = 0
    for line in text.split("\n"):
        own = [(at + m.start(), m[0].translate(low)) for m in re.finditer("[^\x20\x09-\x0d]+", line)]
        raws = [np.frombuffer(w.encode(), np.uint8) for _, w in own]
        least = [int(words.run_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) for raw in raws]
        r, begin = substring.REACH, 0
        for i in range(1, len(own) + 1):
            whole = i == len(own)
            if whole or (i >= r and i + r < len(own) and least[i] < min(least[i - r : i]) and least[i] <= min(least[i + 1 : i + r + 1])):
                out.append((own[begin][0], tuple(w for _, w in own[begin:i])))
                begin = i
        at += len(line) + 1
    return out


def plain_dedup(rows):
    """(units, units removed, new text) of each (id, text): units are compared as words, without digests."""
    found = {key: plain_units(text) for key, text in rows}
    first, out = {}, {}
    for key in sorted(found):
        for i, (_, unit) in enumerate(found[key]):
            first.setdefault(unit, (key, i))
    for key, text in rows:
        starts = [start for start, _ in found[key]]
        stay = [first[unit] == (key, i) for i, (_, unit) in enumerate(found[key])]
        parts = [text[a:b] for a, b, ok in zip(starts, [*starts[1:], len(text)], stay, strict=True) if ok]
        out[key] = (len(stay), stay.count(False), text[: starts[0] if starts else len(text)] + "".join(parts))
    return out


def test_repeats_match_plain_version(spark, edge, empty):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(500)]
    make = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, line = make(60), make(12)
    rows = [(i, make(rnd.randrange(5, 80)) + " " + (passage + " " if i % 3 == 0 else "") + make(9) + "\n" + (line + "\n" if i % 2 else "") + make(3)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_dedup(rows)
    for r in substring.repeated_passages_removed(docs).collect():
        own = dict(rows)[r.doc_id]
        assert (r.n_units, r.n_removed, r.text) == want[r.doc_id]
        assert "".join(own[k.start : k.end] for k in r.kept) == r.text
        if r.doc_id % 3 == 0 and r.doc_id:
            assert passage not in r.text and sum(w in r.text for w in [" ".join(passage.split()[i : i + 30]) for i in range(31)]) == 0
        assert (line in r.text) == (r.doc_id == 1)
    out = substring.repeated_passages_removed(edge).collect()
    assert len(out) == edge.count() and out[0].asDict().keys() == {*edge.columns, "n_units", "n_removed"}
    texts = defaultdict(set)
    for r in out:
        texts[r.doc_id].add(r.text)
    assert texts[4] == {"Same text here, twice over and over."} and texts[5] == {""} and texts[0] == {None} and texts[None] == {"no id here at all"}
    assert substring.repeated_passages_removed(empty).count() == 0


def test_short_and_unspaced_lines_go(spark):
    long = "日本語の段落" * 40
    rows = [(1, f"all rights reserved.\nmine one\n{long}\nx"), (2, f"second\nAll  Rights reserved.\n{long}\ntail of two\nsecond"), (3, "x"), (4, "y" * 300 + "\n" + "y" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n_units, r.n_removed) for r in substring.repeated_passages_removed(docs).collect()}
    assert out == {1: (rows[0][1], 4, 0), 2: ("second\ntail of two\n", 5, 3), 3: ("", 1, 1), 4: ("y" * 300 + "\n", 2, 1)}
    rnd = random.Random(12)
    raw, offs = words.buffers(pa.array([" ".join(str(rnd.randrange(50)) for _ in range(20_000))]))
    assert substring.units(raw, offs)[2].min() >= substring.WORDS


def test_mixing_meets_targets(spark, edge, empty):
    rnd = random.Random(7)
    kinds = ["alpha beta gamma delta", "one### two### three###"]
    rows = [(i, " ".join(rnd.choice(kinds[i % 3 == 0].split()) for _ in range(rnd.randrange(5, 90)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 300, 2)] + [(None, 1), (5000, 0), (1, None)], "doc_id long, quality int")
    model = mixing.fit(docs, labels)
    table, plan, posts = mixing._fitted(docs, model, {"0": 0.4, "1": 0.6}, None, 0.0, "doc_id", "text")
    rates = table.select("tokens", *posts, plan.rate(posts).alias("rate")).collect()
    for d, target in enumerate(plan.targets):  # a plain sum over all rows
        assert sum(r.rate * r.tokens * r[f"p{d}"] for r in rates) == pytest.approx(target, rel=1e-4)
    assert min(r.rate for r in rates) >= 0
    low = mixing._fitted(docs, model, {"0": 0.01, "1": 0.99}, 5000.0, 0.0, "doc_id", "text")
    assert min(r.x for r in low[0].select(low[1].rate(low[2]).alias("x")).collect()) >= 0
    own = mixing.rates(docs, labels, {"0": 0.4, "1": 0.6}).collect()
    assert sum((r.domain == "0") == (r.doc_id % 3 == 0) for r in own) > 290
    copies = Counter(r.doc_id for r in mixing.mixed(docs, labels, {"0": 0.4, "1": 0.6}).collect())
    assert copies == Counter({r.doc_id: r.copies for r in own if r.copies})
    assert mixing.rates(edge, labels).count() == edge.count()
    kept = mixing.mixed(edge, labels, least=1.0)
    assert kept.columns == edge.columns and kept.count() >= edge.count()
    assert mixing.rates(empty, labels).count() == 0 and mixing.mixed(empty, labels.limit(0)).count() == 0


def test_classifier_reads_whole_words(spark):
    """Posteriors follow a plain naive Bayes by words that differ in their beginnings only; white space of any kind parts words."""
    rnd = random.Random(17)
    kinds = [["goodword", "fineword"], ["poorword", "baseword"]]
    rows = [(i, rnd.choice([" ", "  ", "\n", "\t "]).join(rnd.choice(kinds[i % 2] + ["same"]) for _ in range(rnd.randrange(3, 20)))) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, " \n ")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    own = {r.doc_id: r for r in mixing.rates(docs, labels).collect()}
    model = mixing.fit(docs, labels)
    assert all(own[i].domain == str(i % 2) for i in range(400) if set(rows[i][1].split()) != {"same"})
    assert {i: own[i].tokens for i in own} == {i: len((t or "").split()) for i, t in [*rows, (1000, None), (1001, " ")]}
    seen = [Counter(w for i, t in rows[:300] if i % 2 == y for w in t.split()) for y in (0, 1)]
    log = [[math.log((c[w] + 0.5) / (sum(c.values()) + 0.5 * mixing.BUCKETS)) for c in seen] for w in ("goodword", "fineword", "poorword", "baseword", "same")]
    odds = dict(zip(("goodword", "fineword", "poorword", "baseword", "same"), (b - a for a, b in log), strict=True))
    for i, text in rows[:50]:
        parts = text.split()
        score = model.priors[1] - model.priors[0] + sum(odds[w] for w in parts) * model.factor * len(parts) ** (model.power - 1)
        second = 1 / (1 + math.exp(-score))
        assert own[i].posterior == pytest.approx(max(second, 1 - second), abs=1e-9)
    assert own[0].residual < 1e-5


def test_fast_ids_match_the_tokenizer():
    ids = packing.FastIds(packing.vocabulary())
    rnd = random.Random(9)
    letters = [*map(chr, range(0x250)), "’", "日", "ſ", "K", "Σ", "́"]
    texts = ["".join(rnd.choice(letters) for _ in range(50)) for _ in range(300)] + ["it's WE'LL <|endoftext|> x", "", "a  b\n\nc", *(f"a{c}b!{c}!1{c}" for c in letters)]
    for t in texts:
        assert ids(t) == ids._encode(t), t


def plain_placement(lengths, capacity):
    """The rule in words: all sums are counted anew for each piece."""
    gaps, out = [], []
    for s in lengths:
        def total(changed):
            return sum(n * n for g, n in Counter(changed).items() if 0 < g < capacity)

        best = min([(total([*gaps[:i], g - s, *gaps[i + 1 :]]), g, i) for i, g in enumerate(gaps) if g >= s] + [(total([*gaps, capacity - s]), capacity, len(gaps))])
        out.append(capacity - best[1])
        gaps[best[2] : best[2] + 1] = [best[1] - s]
    return out, len(gaps)


def test_placement_follows_the_rule():
    rnd = random.Random(4)
    for n in (1, 40, 250):
        sizes = [rnd.choice([1, 7, 16, 3, 9, 12]) if n > 100 else rnd.randrange(1, 17) for _ in range(n)]
        got = packing.placement(sizes, 16)
        want, sequences = plain_placement(sizes, 16)
        assert [offset for _, offset in got] == want and len({at for at, _ in got}) == sequences


def test_placement_is_valid_and_tight():
    rnd = random.Random(4)
    sizes = np.array([min(64, max(1, int(rnd.lognormvariate(2.5, 1)))) for _ in range(70_000)])
    order = packing.in_passes(sizes)
    assert sorted(order.tolist()) == list(range(70_000))
    filled = defaultdict(int)
    for s, (at, offset) in zip(sizes[order].tolist(), packing.placement(sizes[order].tolist(), 64), strict=True):
        assert filled[at] == offset
        filled[at] += s
    assert max(filled.values()) <= 64 and len(filled) <= 1.001 * -(-int(sizes.sum()) // 64) + 1


def test_packing_in_several_shares(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 100)
    rows = [(i % 300, 0, 1 + i * 37 % 64, i // 300) for i in range(900)] + [(7, 0, 5, 0)] * 50
    pieces = common.table(spark.createDataFrame(rows, "doc_id long, piece int, length long, turn long"), "pieces")
    out = packing.packed(pieces, 64).collect()
    filled = defaultdict(list)
    for r in out:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 64
    assert Counter((r.doc_id, r.length) for r in out) == Counter((a, c) for a, _, c, _ in rows)


def test_other_vocabularies_go_to_their_tokenizer():
    from tokenizers import Tokenizer

    path = packing.vocabulary("byte_bpe_50k.json")
    ids, plain = packing.FastIds(path), Tokenizer.from_file(path)
    assert not ids.fast and packing.FastIds(packing.vocabulary()).fast
    for text in ("Hello there, World 12", "", "it's  WE'LL\n"):
        assert ids(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packed_documents(edge, empty):
    rows = packing.packed_documents(edge).collect()
    plain = packing.FastIds(packing.vocabulary())
    want = Counter()
    for r in edge.collect():
        data = plain._encode(r.text or "") + b"\0" * 4
        for i in range(0, len(data), 8192):
            want[(r.doc_id, i // 8192, i // 4, len(data[i : i + 8192]) // 4, zlib.crc32(data[i : i + 8192]))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 2048
    assert packing.packed_documents(empty).count() == 0


def test_toxicity(spark, edge, empty):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randrange(2, 9))) for _ in range(800)]
    rows = []
    for i in range(900):
        own = [rnd.choice(vocabulary) for _ in range(rnd.randrange(10, 120))]
        if i % 4 == 0:
            for _ in range(3):
                own.insert(rnd.randrange(len(own)), rnd.choice(["zzvile", "qqrotten", "xxnasty"]))
        rows.append((i, " ".join(own), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, training=lambda c: ~toxicity.held_out(c))
    score = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(score[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in held]
    assert np.mean(right) > 0.95
    out = toxicity.scored(edge, model)
    assert out.columns == [*(c for c in edge.columns if c != "score"), "score"] and out.count() == edge.count()
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.scored(empty, model).count() == 0
    assert {r.score for r in toxicity.scored(edge, toxicity.fit(edge, labels.limit(0))).collect()} == {0.0}


def plain_components(texts, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for key, text in texts.items():
        own = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(low))
        sets[key] = set(zip(*(own[k:] for k in range(n)), strict=False)) if len(own) >= n else ({tuple(own)} if own else set())
    top = {k: k for k in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top[a], top[b]))
                    top = {k: x if v == y else v for k, v in top.items()}
    return {k: (len(sets[k]), top[k]) for k in texts}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_match_all_pairs(spark, n, percent):
    rnd = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for size in (1, 2, 3, 9, 12, 20, 40, 90, 160):
        base = [rnd.choice(vocabulary) for _ in range(size)]
        for _ in range(9):
            own = list(base)
            for _ in range(rnd.randrange(4)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append(" ".join(own).title() if rnd.random() < 0.2 else "\n".join(own))
    texts = dict(enumerate(rows))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(docs, n, percent).collect()}
    assert got == plain_components(texts, n, percent)


def test_jaccard_edges(edge, empty):
    rows = ngramjoin.jaccard_components(edge, 3, 90).collect()
    assert len(rows) == edge.count()
    own = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert own[0] == (0, 0) and own[2] == (0, 2) and own[5][1] == 4 and own[8][1] == 7 and own[None][1] is None
    kept = ngramjoin.near_duplicates_removed(edge)
    assert kept.columns == edge.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [0, 1, 2, 3, 4, 4, 6, 7, 9, None]))
    assert ngramjoin.jaccard_components(empty).count() == 0


def test_large_groups_of_copies(spark):
    """Thousands of near copies with pairwise different edits, beside as many that share only a passage."""
    rnd = random.Random(21)
    base, passage = ([f"{x}{rnd.randrange(10**6)}" for _ in range(120)] for x in "bp")
    rows = []
    for i in range(5000):
        own = list(base)
        for k in rnd.sample(range(120), 2):
            own[k] = f"e{i}x{k}"
        rows.append(" ".join(own))
    rows += [" ".join([*passage[:60], *(f"o{i}y{k}" for k in range(60))]) for i in range(2000)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(docs, 5, 80).collect()}
    assert got == {i: 0 if i < 5000 else i for i in range(7000)}


def test_links_of_tiles_match_all_pairs():
    rng = np.random.default_rng(6)
    sets = []
    for size in (30, 31, 300):
        base = rng.integers(0, 1 << 62, size).astype(np.uint64)
        for _ in range(40):
            own = base.copy()
            own[rng.random(size) < 0.1] = rng.integers(0, 1 << 62)
            sets.append(np.unique(np.append(own, rng.integers(0, 1 << 62, size // 20).astype(np.uint64))))
    part, rows = np.arange(len(sets)), np.arange(len(sets))

    def joined(pairs):
        top = list(range(len(sets)))
        for a, b in pairs:
            x, y = sorted((top[a], top[b]))
            top = [x if t == y else t for t in top]
        return top

    whole = [(a, b) for a in rows for b in rows if a < b and 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))]
    halves = [(rows[::2], rows[::2]), (rows[1::2], rows[1::2]), (rows[::2], rows[1::2])]
    for cells in ([(rows, rows)], halves):
        links = ngramjoin.spanning_links([(c[0], c[0]) if c[0] is c[1] or np.array_equal(c[0], c[1]) else c for c in cells], sets, part, 80)
        assert joined(links) == joined(whole) and len(links) < len(sets)


def test_trees_lose_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 6, (40, 8))
    points = (np.repeat(base, 5, 0) + rng.integers(0, 2, (200, 8))).astype(np.int64)
    size = points.sum(1)
    tree = ngramjoin.RTree(points, size)
    got = {(int(a), int(b)) for a, hits in ngramjoin.tree_pairs(tree, tree, 80) for b in hits}
    want = {(i, j) for i in range(200) for j in range(200) if 180 * np.minimum(points[i], points[j]).sum() >= 80 * (size[i] + size[j])}
    assert got == want


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    top = {}
    for a, b in edges:
        if a != b:
            x, y = top.setdefault(a, a), top.setdefault(b, b)
            top = {k: min(x, y) if v in (x, y) else v for k, v in top.items()}
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component_id for r in got} == top and len(got) == len(top)
