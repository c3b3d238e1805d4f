"""Operators against brute force, on planted cases, and on odd rows."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from strayline.llm import decontaminate, html_main, line_dedup, line_rules, masked_lm, mixing, quality_gam, simhash, spans, toxicity
from strayline.llm.common import components, is_held_out, table

SF_LLM = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, words string, row int, _id int"


def sentence(rng, n=8):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def make(spark):
    """Documents from ``{doc_id: text}`` or rows ``(doc_id, text, source)``, with columns in the way."""

    def frame(rows):
        rows = [(k, t, "s") for k, t in rows.items()] if isinstance(rows, dict) else rows
        return spark.createDataFrame([(i, t, "en", s, 1, "x", "y", 2, 3) for i, t, s in rows], SCHEMA)

    return frame


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and long texts, repeated rows, blank lines, ties."""
    rng = random.Random(1)
    long = "\n".join(" ".join(sentence(rng) for _ in range(4)) for _ in range(400))
    rows = [(1, None, "s"), (2, "", "s"), (3, "   \n\t\n", None), (4, long, "s"), (4, long, "s"), (5, "one", None)]
    rows += [(None, "no id here at all", "s"), (None, None, None), (6, "two words", ""), (7, "a" * 50_000, "t"), (5, "other text of five", "t")]
    return make(rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def roots_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    want = roots_of(nodes, [e for e in edges if e[0] != e[1]])
    assert found == {n: r for n, r in want.items() if n != r}


# --- mixing -----------------------------------------------------------------------------------


def targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix(spark, make):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(["a", "b", "b", "b", "Z", None, "é"])) for i in range(900)]
    rows += [(i, "x", "tiny") for i in range(900, 903)]
    docs = make(rows)
    found = mixing.mix(docs, fan=8).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    totals = Counter()
    for i in size:
        totals[source[i]] += size[i]
    want, taken = targets(dict(totals)), Counter()
    assert len(found) == len(rows)
    for r in found:
        assert r["size"] == size[r.doc_id] and r.source_size == totals[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken % r["size"] == 0 and r.taken <= 3 * r["size"]
        assert abs(r.taken / r["size"] - r.target / r.source_size) < 1
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(docs.repartition(5), fan=8).collect()))


def test_mix_is_fair(make):
    docs = make([(i, " ".join("w" * (1 + i % 9)), s) for i in range(60) for s in [("a", "b", "c")[i % 3]]])
    runs = [{r.doc_id: r.taken / r["size"] for r in mixing.mix(docs, seed=k, fan=6).collect()} for k in range(12)]
    share = {r.doc_id: r.target / r.source_size for r in mixing.mix(docs).collect()}
    assert np.mean([np.mean([r[i] for r in runs]) - share[i] for i in share]) == pytest.approx(0, abs=0.05)


def test_mix_deals_out_rows_without_id(make, monkeypatch):
    """Rows of one null id differ in size only; a fold must not get them all."""
    largest = []

    def fold(items, *args, of=mixing._fold):
        largest.append(items)
        return of(F.when(F.size(items) > 40, F.raise_error(F.lit("one group"))).otherwise(items), *args)

    monkeypatch.setattr(mixing, "_fold", fold)
    docs = make([(None, "w " * k, s) for k in range(1, 200) for s in ("a", "b")])
    assert mixing.mix(docs, fan=8).count() == 398 and largest


# --- line dedup -------------------------------------------------------------------------------


def test_line_classes(make):
    rng = random.Random(2)
    base = [" ".join(sentence(rng) for _ in range(4)) for _ in range(30)]
    texts = {}
    for i in range(80):
        lines = []
        for _ in range(3):
            line = rng.choice(base)
            if rng.random() < 0.6:
                k = rng.randrange(len(line))
                line = line[:k] + rng.choice("xyz") + line[k + 1 :]
            lines.append(line)
        texts[i] = "\n".join([*lines, "", "  ", "short one"])
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in line_dedup.line_classes(make(texts)).collect()}
    at = defaultdict(list)
    for i, t in texts.items():
        for k, line in enumerate(t.split("\n")):
            if line.strip():
                at[line.strip().lower()].append((i, k))
    width = line_dedup.WIDTH
    sets = {x: {x[k : k + width] for k in range(max(1, len(x) - width + 1))} for x in at}
    links = [(x, y) for x, y in combinations(at, 2) if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    assert links
    root = roots_of(at, links)
    first = defaultdict(lambda: (10**9, 0))
    for x, places in at.items():
        first[root[x]] = min(first[root[x]], *places)
    assert got == {p: first[root[x]] for x, places in at.items() for p in places}


@pytest.mark.parametrize("small_band", [line_dedup.SMALL_BAND, 1])
def test_line_classes_around_a_pivot(make, monkeypatch, small_band):
    """Lines that stay near the limit of each other, each unlike a common form in its own places; by
    sketch, and by the search of large bands."""
    monkeypatch.setattr(line_dedup, "SMALL_BAND", small_band)
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("stra", "mel", "por") for b in ("tin", "ul") for c in ("do", "nek", "va")]
    base = [rng.choice(words) for _ in range(45)]
    texts = {}
    for i in range(120):
        line = list(base)
        for _ in range(rng.randrange(4, 9)):
            line[rng.randrange(len(line))] = rng.choice(words[:6])
        texts[i] = " ".join(line)
    width = line_dedup.WIDTH
    sets = {i: {t[k : k + width] for k in range(len(t) - width + 1)} for i, t in texts.items()}
    links = [(i, k) for i, k in combinations(texts, 2) if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])]
    root = roots_of(texts, links)
    least = {r: min(i for i in texts if root[i] == r) for r in set(root.values())}
    got = {r.doc_id: r.kept_doc_id for r in line_dedup.line_classes(make(texts)).collect()}
    assert got == {i: least[root[i]] for i in texts}
    assert 1 < len(least) < len(texts)


def test_short_lines_with_one_edit(make):
    """Lines of 50 to 70 characters as the pipeline and the query compare them, against brute force over shingles of 5."""
    rng = random.Random(15)
    texts = {}
    for i in range(40):
        line = "".join(rng.choices("abcdefghijklmnop ", k=rng.randrange(50, 70)))
        k = rng.randrange(10, 40)
        texts[2 * i] = f"x{line}x"
        texts[2 * i + 1] = f"x{line[:k]}7{line[k + 1:]}x"
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in texts.items()}
    links = [(i, k) for i, k in combinations(texts, 2) if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])]
    assert len(links) > 30
    root = roots_of(texts, links)
    left = {r.doc_id for r in line_dedup.dedup_lines(make(texts)).collect()}
    assert left == set(root.values())


def test_dedup_lines(make, odd, no_docs):
    line = "This line is long enough to be compared with another line."
    docs = make({1: f"{line}\nOwn text of the first.", 2: f"\n{line}\n", 3: f"{line.upper()}\n\nOwn text of the third."})
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert left == {1: f"{line}\nOwn text of the first.", 3: "\nOwn text of the third."}
    kept = line_dedup.dedup_lines(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in odd.collect())
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_classes_without_python(make, monkeypatch):
    """DataFrame operations alone; short lines and lines that repeat themselves link as brute force says."""
    docs = make({i: x for i, x in enumerate(
        ["=" * 40, "=" * 7, "| --- | --- | --- |", "| --- | --- | --- | --- |", "abcdefghi", "abcdefgh", "ijklmnop", "ab", "AB "]
    )})

    def refused(*args, **kwargs):
        raise AssertionError("Python on executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, refused)
    got = {r.doc_id: r.kept_doc_id for r in line_dedup.line_classes(docs, width=5).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7}


def test_line_classes_split_texts_once(make, monkeypatch):
    """Lines of words, with edits, a passage of others, or shuffled, link as brute force says; texts are split
    into lines by one scan, however many steps compare them."""
    rng = random.Random(33)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(1, 12))) for _ in range(400)]
    texts, scans = [], []
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([8, 14, 30, 60]))
        for _ in range(4):
            line = list(base)
            for _ in range(rng.randrange(len(base) // 8 + 1)):
                line[rng.randrange(len(line))] = rng.choice(words)
            texts.append(" ".join(line))
        texts.append(" ".join(rng.sample(base, len(base))))
        texts.append(" ".join(base[: len(base) // 2] + rng.choices(words, k=len(base))))
    texts = dict(enumerate(texts))
    sets = {i: {t[k : k + 5] for k in range(max(1, len(t) - 4))} for i, t in texts.items()}
    links = [(i, k) for i, k in combinations(texts, 2) if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])]
    root = roots_of(texts, links)
    least = {r: min(i for i in texts if root[i] == r) for r in set(root.values())}
    lines = line_dedup._lines
    monkeypatch.setattr(line_dedup, "_lines", lambda docs: scans.append(1) or lines(docs))
    got = {r.doc_id: r.kept_doc_id for r in line_dedup.line_classes(make(texts), width=5).collect()}
    assert got == {i: least[root[i]] for i in texts}
    assert 40 < len(least) < len(texts) and len(scans) == 1


def test_signatures_are_minima_over_shingles():
    rng = random.Random(21)
    lines = ["".join(rng.choices("abcdé中😀 ", k=rng.choice([1, 2, 4, 5, 6, 30]))) for _ in range(60)]
    got = line_dedup.signatures(lines, 5)
    alone = [line_dedup.signatures([x], 5)[0].tolist() for x in lines]
    assert got.tolist() == alone  # a line's signature is its own
    for x, row in zip(lines, alone):
        shingles = {x[k : k + 5] for k in range(max(1, len(x) - 4))}
        each = np.array([line_dedup.signatures([s], 5)[0] for s in shingles])
        assert row == each.min(axis=0).tolist()


# --- simhash ----------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark, odd, no_docs):
    docs = table(spark, SF_LLM, "documents")
    want = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    links = [(i, j) for i, j in combinations(sorted(want), 2) if (want[i] ^ want[j]).bit_count() <= 3]
    root = roots_of(want, links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", root[i]) for i, f in want.items()}
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    assert {r.component_id for r in found if r.fingerprint == "0" * 16} == {1}
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns


def test_keep_one_decides_by_row(make, odd):
    """Rows without id, and one id with several texts."""
    kept = Counter((r.doc_id, r.text and r.text[:30]) for r in simhash.keep_one(odd).collect())
    first = next(r.text for r in odd.collect() if r.doc_id == 4)[:30]
    want = [(1, None), (4, first), (5, "one"), (None, "no id here at all"), (6, "two words"), (7, "a" * 30), (5, "other text of five")]
    assert kept == Counter(want)
    rng = random.Random(16)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (None, a, "s"), (None, c, "s"), (None, c, "t"), (3, b, "s")]
    assert Counter((r.doc_id, r.text) for r in simhash.keep_one(make(rows)).collect()) == Counter([(1, a), (2, b), (None, c)])


def test_links_reach_every_pair_within_three_bits(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)}
    rows = [(p - 2**64 if p >> 63 else p,) for p in prints]
    got = {r.node: r.root for r in components(simhash.link(spark.createDataFrame(rows, "fp long"))).collect()}
    nodes = [r[0] for r in rows]
    links = [(u, v) for u, v in combinations(nodes, 2) if ((u ^ v) & (2**64 - 1)).bit_count() <= 3]
    want = roots_of(nodes, links)
    assert {n: got.get(n, n) for n in nodes} == want


# --- decontamination --------------------------------------------------------------------------


def test_overlaps(spark, make, odd, no_docs):
    rng = random.Random(6)
    items = {k: " ".join(sentence(rng, n) for n in (9, 11)) for k in range(40)}
    items[40], items[41], items[42] = "one two three four five six seven eight nine", "too short an item", None
    benchmark = spark.createDataFrame([(k, t, "z") for k, t in items.items()], "item_id long, text string, words string")

    def around(text):
        return f"{sentence(rng, 40)} {text} {sentence(rng, 40)}"

    texts = {k: around(items[k].upper()) for k in range(20)}
    for k in range(20, 30):  # every sixth word replaced
        words = items[k].split()
        texts[k] = around(" ".join("zzz" if i % 6 == 3 else w for i, w in enumerate(words)))
    texts |= {40: around(items[40]), 41: around(items[41])}
    texts |= {k: around(" ".join(items[k % 40].split()[:6])) for k in range(100, 120)}  # too little
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(make(texts), benchmark).collect()}
    assert set(got) == {(k, k) for k in (*range(30), 40)}
    assert all((got[k, k].start, got[k, k].n_agree) == (40, 20) for k in range(20))
    left = {r.doc_id for r in decontaminate.drop_contaminated(make(texts), benchmark).collect()}
    assert left == {41, *range(100, 120)}
    assert decontaminate.overlaps(odd, benchmark).count() == 0
    assert decontaminate.overlaps(no_docs, benchmark).count() == 0
    assert decontaminate.overlaps(odd, benchmark.limit(0)).count() == 0


# --- line rules -------------------------------------------------------------------------------


def test_base_figures(spark, odd, no_docs):
    docs = table(spark, SF_LLM, "documents").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    rows = docs.collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in line_rules.clean_lines(docs).collect())
    want = Counter()
    for r in rows:
        text = r.text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        count = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want[r.doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
             len(lines) - len(set(lines)), len(covered), failed] += 1
    assert got == want
    assert line_rules.clean_lines(no_docs).count() == 0


def test_lines_are_cleaned_before_the_verdict(make):
    rng = random.Random(8)
    good = [sentence(rng, 12) for _ in range(8)]
    junk = ["Home | News | About | Contact", "ALL IN CAPITALS AND LOUD", "We use cookies on this site.", "a# b$ c% d&", "Read more"]
    docs = make({1: "\n".join(good[:4] + junk + good[4:]), 2: "\n".join(good[:5] + junk * 20)})
    got = {r.doc_id: r for r in line_rules.clean_lines(docs).collect()}
    assert got[1].clean_text == "\n".join(good) and got[1].kept
    assert not got[2].kept


# --- spans ------------------------------------------------------------------------------------


def test_remove_repeats(make, odd, no_docs):
    rng = random.Random(9)
    passage = " ".join(sentence(rng) for _ in range(6))
    own = {k: (sentence(rng, 12), sentence(rng, 12)) for k in range(6)}
    texts = {k: f"{a} {passage} {b}" if k < 4 else f"{a} {b}" for k, (a, b) in own.items()}
    texts[9] = f"{own[5][0]}\n{passage.replace('.', '!', 1)}"
    got = {r.doc_id: r for r in spans.remove_repeats(make(texts)).collect()}
    assert got[0].text == texts[0] and got[0].removed == 0
    for k in (1, 2, 3):
        assert got[k].text == f"{own[k][0]} {own[k][1]}" and got[k].kept_doc_ids == [0] and got[k].removed == 6
    assert got[4].text == texts[4] and got[5].text == texts[5]
    assert passage.split(". ")[0] in got[9].text.replace("!", ".") and passage.split(". ", 1)[1] not in got[9].text
    twice = spans.remove_repeats(make({1: f"{passage}\n{own[0][0]}\n{passage}"})).first()
    assert twice.text == f"{passage}\n{own[0][0]}\n"
    found = spans.remove_repeats(odd)
    assert sorted(map(str, (r.text for r in found.collect()))) == sorted(map(str, (r.text for r in odd.collect())))
    assert spans.remove_repeats(no_docs).count() == 0


def test_remove_repeats_of_short_pieces(make):
    """Lists, menus and texts of few words, against every run of three pieces."""
    rng = random.Random(13)
    menu = "\n".join(f"item{k}" for k in range(60)) + "\n"
    texts = {1: f"Some text of its own.\n{menu}", 2: f"Other words stand here.\n{menu}The end of it.", 3: "Just four words here", 4: "just four words here", 5: "一二三四五六", 6: "一二三四五六"}
    got = {r.doc_id: r for r in spans.remove_repeats(make(texts)).collect()}
    assert {i: r.text for i, r in got.items()} == texts | {2: "Other words stand here.\nThe end of it.", 4: "", 6: ""}
    assert got[2].removed == 60
    pieces = {i: [rng.choice(["a, ", "b b. ", "c c c; ", "d\n"]) for _ in range(rng.randint(1, 12))] for i in range(40)}
    seen, want = set(), {}
    for i, parts in pieces.items():
        gone = set()
        count = min(3, len(parts))
        for k in range(len(parts) - count + 1):
            run = tuple(x.strip() for x in parts[k : k + count])
            gone |= set(range(k, k + count)) if run in seen else set()
            seen.add(run)
        want[i] = "".join(x for k, x in enumerate(parts) if k not in gone)
    texts = {i: "".join(parts) for i, parts in pieces.items()}
    assert {r.doc_id: r.text for r in spans.remove_repeats(make(texts)).collect()} == want


# --- classifiers ------------------------------------------------------------------------------


@pytest.mark.parametrize("score,label,least", [(toxicity.score_toxicity, "toxic", 0.9), (quality_gam.score_quality, "quality", 0.97)])
def test_held_out_accuracy(spark, odd, no_docs, score, label, least):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    true = {r.doc_id: r[label] for r in labels.collect()}
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in true]
    assert np.mean([r.predicted == true[r.doc_id] for r in held]) > least
    few = labels.limit(0)
    assert {r.score for r in score(odd, few).collect()} == {0.5}
    assert score(no_docs, few).count() == 0
    assert len(score(odd, labels).collect()) == odd.count()


def test_held_out_rule(spark):
    rows = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in rows.select("doc_id", is_held_out(rows.doc_id)).collect()}
    assert got == {k: crc32(str(k).encode()) % 3 == 1 for k in range(50)} | {None: False}


# --- masked language model --------------------------------------------------------------------


def test_log_probabilities_sum_to_one():
    net = masked_lm._unpack(np.random.default_rng(1).normal(0, 0.3, len(masked_lm._pack(masked_lm._start()))))
    around = np.random.default_rng(2).integers(0, masked_lm.SIZE, (len(masked_lm.OFFSETS), 1))
    total = 0.0
    for high in range(masked_lm.SIDE):
        _, p_high, p_low = masked_lm._forward(net, around, np.array([high]))
        total += float(np.exp(p_high[0, high] + p_low[0]).sum())
    assert total == pytest.approx(1, abs=1e-4)


def test_exponentials_need_no_greatest_and_stay_finite():
    """Those of a step are taken once; scores too large for a float lose the greatest of their row first."""
    net = masked_lm._unpack(np.random.default_rng(1).normal(0, 0.3, len(masked_lm._pack(masked_lm._start()))))
    around = np.random.default_rng(2).integers(masked_lm.PAD, masked_lm.SIZE, (len(masked_lm.OFFSETS), 50))
    high = np.arange(50) % masked_lm.SIDE
    for factor in (1, 1000):
        net["high"] = net["high"] * np.float32(factor)
        hidden, *parts = masked_lm._parts(net, around, high)
        biases = net["high_bias"], net["low_bias"][high]
        for (_, e, total), kind, bias in zip(parts, ("high", "low"), biases):
            z = (hidden.astype(float) @ net[kind] + bias).astype(float)
            want = np.exp(z - z.max(axis=1, keepdims=True))
            assert np.allclose(e / total, want / want.sum(axis=1, keepdims=True), atol=1e-3 if factor > 1 else 1e-5)


def test_classes_of_words_are_told_for_all_at_once():
    words = [b"a", b"ab", b"abc", "\u00e9\u00df\U0001f600".encode(), b"x" * 300, b"\xff\xfe"]
    want = [5 + (31 * len(w) + 7 * w[0] + 13 * w[-1] + w[len(w) // 2]) % (256 - 5) for w in words]
    ids = dict(zip([b"the", b"of", b"and", b"to", b"in"], range(5)))
    assert masked_lm._class(words, 5, 16).tolist() == want
    assert masked_lm.tokens(b" \x0b".join([b"THE", *words, b"in"]), ids).tolist() == [0, *want, 4]
    assert masked_lm.tokens(None, ids).tolist() == masked_lm.tokens(b" \n", ids).tolist() == []


def test_order_matters_to_the_score(spark, odd, no_docs):
    rng = random.Random(10)
    text = lambda: " ".join(f"a{k} b{k} c{k}" for k in rng.choices(range(20), k=120))
    rows = [(k, text()) for k in range(120)]
    mixed = [(1000 + k, " ".join(rng.sample(t.split(), len(t.split())))) for k, t in rows[:10]]
    docs = spark.createDataFrame(rows * 3 + mixed, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.mean_log_likelihood for r in masked_lm.score(docs).collect()}
    assert all(got[1000 + k] < got[k] for k in range(10))
    found = masked_lm.score(odd).collect()
    assert len(found) == odd.count() and all(r.log_likelihood == 0 for r in found if r.n_tokens == 0)
    assert masked_lm.score(no_docs).count() == 0


def test_every_word_has_its_own_probability(spark):
    """Words of one class that differ in how often the corpus has them; a vocabulary that grows."""
    rng = random.Random(12)
    common = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choices(common, k=400))) for k in range(60)]
    rows += [(100 + k, "w1 w2 axbxz w3 w4") for k in range(20)]
    rows += [(200, "w1 w2 aybxz w3 w4"), (201, "W1 w2 aybxz w3 w4"), (200, "w1 w2 aybxz w3 w4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    counts = masked_lm.word_counts(docs)
    want = Counter(w for _, t in rows for w in t.lower().split())
    assert {r.word.decode(): r.n for r in counts.collect()} == want
    ids = masked_lm.vocabulary(counts)
    assert set(common) == {w.decode() for w in ids}
    assert len(masked_lm.vocabulary(masked_lm.word_counts(docs.where("doc_id < 1")))) < 300
    assert masked_lm.tokens(b"axbxz", ids) == masked_lm.tokens(b"aybxz", ids)
    got = masked_lm.score(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    at = {r.doc_id: r.log_likelihood for r in got}
    assert at[100] - at[200] == pytest.approx(np.log(20 / 3), abs=1e-5)
    assert at[201] == pytest.approx(at[200])


# --- main text --------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="page"><header><h2>Site</h2></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We store things, and more things, on your machine.</div>
<main><div class="post"><h1>A &amp; B</h1><p>First   part,\nwith <b>bold<br>text, and &lt;tags&gt;.<p>Second part, of the
 text, which is longer than the first.</p><ul><li>One item<li>Two</ul></div><div class="ad">Buy, buy, buy!</div></main>
<aside>Other, things, to, read.</aside><section id="comments"><p>Nice, very nice, thanks!</p></section>
<form><p>Your name, please.</p></form><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    want = "A & B\nFirst part, with bold text, and <tags>.\nSecond part, of the text, which is longer than the first.\nOne item\nTwo"
    assert html_main.main_text(PAGE) == want
    assert [html_main.main_text(x) for x in (None, "", "<p", "<!-- open", "<script>x")] == [""] * 5
    assert html_main.main_text("plain text, no markup") == "plain text, no markup"
    assert html_main.main_text("<div>" * 3000 + "deep text.") == "deep text."
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 1), (None, "v", "<p>x y.</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_main.extract(pages).collect()
    assert sorted((r.n_chars, r.text) for r in got) == sorted([(len(want), want)] * 2 + [(0, ""), (4, "x y.")])
    assert html_main.extract(pages.limit(0)).count() == 0


LONG = "A sentence of the article, with commas, and with words enough to count, stands here."


@pytest.mark.parametrize("around", [
    '<article class="post no-sidebar">', '<article class="widget">', '<div class="content-sidebar-wrap">', '<div class="has-share">',
    '<div class="elementor-widget elementor-widget-text-editor">', '<div class="widget">', '<div class="sidebar-page"><main>',
])
def test_names_around_the_article_do_not_drop_it(around):
    page = f"<body>{around}<h2 class='section-header'>Head</h2><p>{LONG}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be so.</p></body>"
    assert html_main.main_text(page) == f"Head\n{LONG}\nLet x=1 be so."


def test_named_parts_beside_the_article_go():
    talk = f"<div class='comments-area'><p>{LONG * 9}</p></div>"
    page = f"<body><div class='post'><p>{LONG}</p><div class='ad-slot'>Buy, buy.</div><div id='related'>{LONG}</div></div>{talk}</body>"
    assert html_main.main_text(page) == LONG


def test_short_parts_of_the_article_stay():
    links = "<ul><li><a href=/a>Other page</a><li><a href=/b>One more page</a></ul>"
    parts = f"<div><p>{LONG * 3}</p></div><div>Short one</div><ul><li>Item<li>Two</ul><blockquote>Quoted</blockquote>"
    want = f"Head\n{LONG * 3}\nShort one\nItem\nTwo\nQuoted\nLast"
    page = f"<body><div><div><h2>Head</h2>{parts}{links}</div><section>Last</section></div>{links}</body>"
    assert html_main.main_text(page) == want
    assert html_main.main_text(f"<body><main>{parts}</main><div>Beside it</div></body>") == want[5:-5]


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF_LLM, "documents")
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, SF_LLM).collect(), schema=stage(spark, docs, SF_LLM).schema)
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2]
    assert corpus_pipeline.run(spark, SF_LLM).count() == sizes[-1]


def test_tokens_are_told_once_and_kept(spark):
    """Training and scoring read what one pass split, in the partitions of the texts."""
    texts = ["The cat SAW the dog", None, " \n", "the axbxz of the cat", "café the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    ids = {w: k for k, w in enumerate([b"the", b"cat", b"of"])}
    rows = masked_lm.tokenized(docs, ids).collect()
    assert [r.doc_id for r in rows] == list(range(5))
    want = [masked_lm.tokens(t and t.encode(), ids).tolist() for t in texts]
    assert [x.tolist() for x in masked_lm._read_tokens([r.tokens for r in rows], ids)] == want
    many = {str(k).encode(): k for k in range(40_000)}  # needs four bytes
    rows = masked_lm.tokenized(docs.selectExpr("doc_id", "'39999 7 x' as text"), many).collect()
    assert masked_lm._read_tokens([rows[0].tokens], many)[0][:2].tolist() == [39_999, 7]


@pytest.mark.parametrize("columns", [1, 16, 17])
def test_sums_of_equal_tokens(columns):
    draw = np.random.default_rng(4)
    ids, rows = draw.integers(-1, 40, 300), draw.normal(size=(300, columns)).astype(np.float32)
    for shift in (0, 100_000):
        found, sums = masked_lm._sums(rows, ids + shift)
        assert found.tolist() == sorted(set((ids + shift).tolist()))
        assert np.allclose(sums, [rows[ids + shift == k].sum(axis=0) for k in found], atol=1e-4)
