"""Each operator's method against brute force, an invariant or held-out rows, on small fixtures."""

import itertools
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from outage_spark.llm import (
    components, decontamination, jaccard_join, license_scan, mixture, personal_data, quality_rules, repeated_passages, text,
    token_rollup, toxicity, url_filter,
)
from outage_spark.llm.queries import QUERIES, SQL
from tests.compare import assert_same, connect
from tests.llm.helpers import lower, prose, table, words

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert assert_same(QUERIES[name](spark, SMALL), connect(SMALL), SQL[name]) >= 0


def test_registration():
    names = [q for q in __spark_entry__.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries() and len(corpus_pipeline.STAGES) == 5


def _classes(sets, percent):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block,frequent", [(512, 64), (8, 3)])
def test_jaccard_classes_equal_all_pairs(spark, monkeypatch, block, frequent):
    """Families of edited copies, a shared passage, borderline pairs; with tiny blocks and many frequent tokens too."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rng = random.Random(block)
    rows, passage = [], prose(rng, 14)
    for family in range(6):
        base = prose(rng, rng.choice([12, 40, 200])).split()
        for _ in range(15):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10)}"
            rows.append((len(rows), " ".join(copy), "s"))
    rows += [(len(rows) + i, passage + " " + prose(rng, 3), "s") for i in range(30)]
    sets = {}
    for i, body, _ in rows:
        w = words(lower(body))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))}
    got = {r.id_key: (r.n_shingles, r.component_id) for r in jaccard_join.similar_classes(table(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), c) for i, c in _classes(sets, 85).items()}


def test_jaccard_bins_never_overstate_a_difference():
    """Also where numbers of bins differ, and bins hold more than 16 tokens; unrelated large sets are far apart."""
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 40, 1536, 1537, 3000, 3200, 9000, 14000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [base, base[: max(1, n * 9 // 10)], np.append(base, rng.integers(0, 1 << 63, 1 + n // 20, dtype=np.uint64))]
        sets.append(np.arange(n, dtype=np.uint64) << np.uint64(27))
    i, j = np.triu_indices(len(sets), 1)
    differ = jaccard_join._Bins([jaccard_join._bins(s) for s in sets]).differ(i, j, cells=1 << 14)
    real = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (differ <= real).all() and differ.max() > 0
    a, b = (rng.integers(0, 1 << 63, 9000, dtype=np.uint64) for _ in range(2))
    assert jaccard_join._Bins([jaccard_join._bins(a), jaccard_join._bins(b)]).differ(np.array([0]), np.array([1]))[0] > 9000 * 2 / 9


def test_jaccard_large_sets_with_one_common_token_are_no_candidates(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(4):
        tokens = rng.integers(0, 1 << 63, 8000, dtype=np.uint64)
        if k == 3:
            tokens = np.append(first[:7900], tokens[:100])
        first = tokens if not k else first
        rows.append((k + 1, len(tokens), k + 1, jaccard_join._bins(tokens), [77]))
    sets = spark.createDataFrame(rows, "set_key bigint, n bigint, class bigint, bins binary, keys array<bigint>")
    assert [tuple(r) for r in jaccard_join._candidates(sets, 80).collect()] == [(1, 4)]


def test_jaccard_pairs_leave_few_of_their_entries():
    """The first key that two sets share is among those, and most of a long shared run is not."""
    rng = random.Random(6)
    for share in (0.2, 0.9):
        lists = [[k for k in range(1, 200) if rng.random() < share] for _ in range(12)]
        for a, b in itertools.combinations(lists, 2):
            at = [(a.index(k), b.index(k)) for k in sorted(set(a) & set(b))]
            if at:
                before = [
                    np.array([x[i - d] if i >= d else 0 for x, i in [(a, i) for i, _ in at] + [(b, j) for _, j in at]])
                    for d in range(1, jaccard_join.BEFORE + 1)
                ]
                left = jaccard_join._first_shared(before, np.arange(len(at)), np.arange(len(at)) + len(at)).tolist()
                assert left[0] == 0 and (share < 0.9 or len(left) < len(at) / 4)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (101, 100), (7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(1, 31)} | {101: 100, 102: 100}


def test_repeated_passages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeated_passages, "PIECE", 3)
    monkeypatch.setattr(repeated_passages, "AUTOMATON_PHRASES", 10)
    rng = random.Random(1)
    shared = [prose(rng, n).split() for n in (13, 14, 30, 60)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(1, 20), 30).split()] + [p[rng.randrange(3) :] for p in rng.sample(shared, 2)]
        rng.shuffle(parts)
        rows.append((i, " ".join(itertools.chain(*parts)), "s"))
    first = {}
    for i, body, _ in rows:
        w = words(body)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {}
    for i, body, _ in rows:
        w = words(body)
        gone = {k + o for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for o in range(13)}
        want[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    got = {r.doc_id: r.kept_text for r in repeated_passages.remove_repeats(table(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("block_words", [1_000_000, 5])
def test_phrases_and_proximity(spark, block_words):
    rng = random.Random(2)
    item = prose(rng, 25).split()
    near = item[:4] + ["zz"] + item[4:6] + item[7:12]
    rows = [(1, "a " + " ".join(item[3:14]) + " b", "s"), (2, " ".join(near), "s"), (3, prose(rng, 50), "s"), (4, "Short, ITEM here", "s")]
    docs, items = table(spark, rows), spark.createDataFrame([(10, " ".join(item)), (11, "short item"), (12, " ".join(item))], "item_id bigint, text string")
    found = decontamination.find_contamination(docs, items, block_words=block_words)
    assert {r.doc_id: (r.n_hit, r["items"]) for r in found.collect()} == {1: (11, ["10", "12"]), 4: (2, ["11"])}
    block = next(decontamination.benchmark_blocks(items))
    index = decontamination.build_index(docs, block, gap=8, missing=2)
    close = decontamination.proximity_matches(index, block, slop=3, missing=2)
    assert {r.doc_id for r in close.where("item = '10'").collect()} == {1, 2}


def test_mixture_keeps_words_and_expectations(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), "hot" if i % 3 else f"s{i % 4}") for i in range(900)]
    docs = table(spark, rows).withColumns({"size": text.word_count("text"), "k": F.xxhash64("text")})
    targets = mixture.source_targets(docs, "size", "source")
    seen = defaultdict(list)
    for seed in range(3):
        mixed = mixture.mix(docs, targets, "size", "source", ["doc_id", "k"], seed=seed, block_rows=16)
        for r in mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.first("target").alias("t"), F.max("copies").alias("m")).collect():
            assert abs(r.n - r.t) <= 60 and r.m <= 2
        again = mixture.mix(docs.repartition(7), targets, "size", "source", ["doc_id", "k"], seed=seed, block_rows=16)
        assert mixed.exceptAll(again.select(mixed.columns)).count() == 0
        seen[seed] = [r.copies for r in mixed.orderBy("doc_id").collect()]
    assert len({tuple(c) for c in seen.values()}) == 3
    total = sum(len(b.split()) for _, b, _ in rows)
    assert abs(targets.agg(F.sum("target")).first()[0] - 1.5 * total) < 1e-6


@pytest.mark.parametrize("block_rows", [4096, 64])
def test_mixture_shares_do_not_depend_on_size(spark, block_rows):
    """3900 short and 100 long documents, wanted shares 0.2 and 0.8, in eight sources and under three seeds."""
    size = F.when(F.col("n") % 40 == 0, 100).otherwise(1).cast("bigint")
    docs = spark.range(8 * 4000).select("id", F.floor(F.col("id") / 4000).cast("string").alias("source"), (F.col("id") % 4000).alias("n"))
    docs = docs.select("id", "source", size.alias("size")).cache()
    targets = docs.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    share = F.when(F.col("source") < "4", 0.2).otherwise(0.8)
    targets = targets.withColumn("target", share * F.col("source_size")).cache()
    taken, rows = Counter(), Counter()
    for seed in range(3):
        mixed = mixture.mix(docs, targets, "size", "source", ["id"], seed=seed, block_rows=block_rows)
        for r in mixed.groupBy((F.col("source") < "4").alias("few"), "size").agg(F.sum("copies").alias("c"), F.count("*").alias("n")).collect():
            taken[r.few, r.size] += r.c
            rows[r.few, r.size] += r.n
    for (few, one), n in rows.items():
        wanted = 0.2 if few else 0.8
        assert abs(taken[few, one] / n - wanted) < 4.5 * (0.16 / n) ** 0.5, (few, one, taken[few, one] / n)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    bad = ["grobian", "lumpkin", "scroundel", "vilein"]
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, 40, 300).split()
        if i % 5 == 0:
            for _ in range(2):
                w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, ". ".join(" ".join(w[k : k + 8]) for k in range(0, 40, 8)), "s"))
        labels.append((i, 1, int(i % 5 == 0)))
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, known)
    scored = toxicity.score(docs, model).where(toxicity.held_out()).join(known, "doc_id")
    assert scored.count() > 100
    assert scored.where("(score >= 0.7) <> (toxic = 1)").count() == 0
    clauses = toxicity.toxic_clauses(docs, model)
    assert all(any(b in r.clause for b in bad) for r in clauses.collect())


def test_grammar_reads_whole_clauses():
    matcher = toxicity.Matcher(toxicity.Lexicon({"idiot": 1.0}, {"lowei": 1.0}))
    kinds = lambda t: [k for _, k in matcher.clauses(t)]
    assert kinds("You absolute idiot. Fine day!") == [{"insult", "insult+target"}]
    assert kinds("He is not an idiot") == [{"insult", "insult-negated"}]
    assert kinds("They said loweixy and left") == [{"insult", "insult-reported"}]
    assert kinds("I will kill the lights. you idiot") == [{"threat"}, {"insult", "insult+target"}]
    assert kinds(None) == kinds("nothing here") == []


def test_contexts_find_what_patterns_miss(spark):
    rng = random.Random(6)
    rows = [(i, f"{prose(rng, 5)} hotline: +49 (30) 555-{1000 + i} end", "s") for i in range(8)]
    rows += [(20, "call hotline: 030/5559999 now", "s"), (21, "in the year 2024 we had 1234567 things", "s")]
    found = personal_data.find_personal_data(table(spark, rows))
    added = {r.doc_id: [s.value for s in r.added] for r in found.collect()}
    assert added[20] == ["030/5559999"] and not added[21] and not added[0]
    clean = {r.doc_id: r.text for r in personal_data.redact(table(spark, rows)).collect()}
    assert clean[20] == "call hotline: [phone] now" and clean[0].endswith("hotline: [phone] end") and clean[21] == rows[-1][1]


def test_grouped_identifiers(spark):
    rng = random.Random(16)
    rows = [(i, f"{prose(rng, 5)} hotline: +49 (30) 555-{1000 + i} end", "s") for i in range(16)]
    rows += [(20, "call hotline: 030 555 99 99, or not", "s"), (21, "hotline: 030 555 99 98", "s"), (22, "rows 12 13 14 15 of 2024", "s")]
    rows += [(23, "hotline: 030 55a 1", "s"), (24, " ".join(map(str, range(100, 140))), "s"), (None, "hotline: 030 555 99 98", None)]
    docs = table(spark, rows)
    added = {r.doc_id: [s.value for s in r.added] for r in personal_data.find_personal_data(docs).collect()}
    assert added[20] == ["030 555 99 99"] and added[21] == added[None] == ["030 555 99 98"]
    assert not added[22] and not added[23] and not added[24]
    clean = [(r.doc_id, r.text) for r in personal_data.redact(docs).collect()]
    assert (20, "call hotline: [phone], or not") in clean and clean.count((21, "hotline: [phone]")) == 1
    assert (None, "hotline: [phone]") in clean and len(clean) == len(rows)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    doubled = [int(d) * 2 - 9 * (int(d) > 4) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(7)
    pieces = ["a@b.c", "a@b.c_d@e.f", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1112",
              "+1 (988) 555-2485", "+1", "+12 3", "é", "𝄞", " ", "..", "@", "9" * 25, "a.b%c@d-e.fg..h", "\n", "5 5", "0000000000000000"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(12))), "s") for i in range(400)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in personal_data.find_personal_data(table(spark, rows)).collect()}
    for i, body, _ in rows:
        want = []
        for n, (kind, pattern) in enumerate(BASE.items()):
            for m in re.finditer(pattern, body):
                d = re.sub("[^0-9]", "", m.group())
                good = kind == "email" or kind == "ip" and all(int(x) < 256 for x in m.group().split("."))
                good = good or kind == "card" and 16 <= len(d) <= 19 and _luhn(d) or kind == "phone" and 8 <= len(d) <= 15
                if good:
                    want.append((n, m.start(), m.end()))
        assert got[i] == want, body


def test_licenses_in_edited_texts(spark):
    rng = random.Random(8)
    full = license_scan.TEMPLATES["MIT"][1].split()
    edited = full[:20] + ["really"] + full[21:]
    cut = full[: len(full) // 2]
    rows = [(1, prose(rng, 33) + " " + " ".join(edited) + " " + prose(rng, 50), "s"), (2, " ".join(cut), "s"), (3, prose(rng, 9) + " Released under the MIT License. " + prose(rng, 9), "s")]
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(table(spark, rows)).collect()}
    assert got == {(1, "MIT"), (3, "MIT")}


def test_licenses_are_told_apart(spark):
    """Notices of the GNU family and whole BSD and other texts are each found as themselves only."""
    rng = random.Random(18)
    texts = [(name, part) for name, parts in license_scan.TEMPLATES.items() for part in parts if len(part.split()) > 30]
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC"} <= {n for n, _ in texts}
    rows = [(i, prose(rng, i) + " " + part + " " + prose(rng, 20), "s") for i, (_, part) in enumerate(texts)]
    got = defaultdict(set)
    for r in license_scan.scan_licenses(table(spark, rows)).collect():
        got[r.doc_id].add(r.license)
    # Whole GNU texts quote further notices at their end.
    for i, (name, part) in enumerate(texts):
        assert name in got[i] if len(part.split()) > 1000 else got[i] == {name}, (name, got[i])


def test_licenses_with_inserted_words(spark):
    """Twelve words put into the opening of MIT; the result does not depend on the words before it."""
    rng = random.Random(19)
    full = license_scan.TEMPLATES["MIT"][1].split()
    for k in (20, 35):
        full[k:k] = prose(rng, 6).split()
    rows = [(i, prose(rng, i) + " " + " ".join(full) + " " + prose(rng, 30), "s") for i in range(9)]
    got = license_scan.scan_licenses(table(spark, rows)).collect()
    assert {(r.doc_id, r.license, r.first_shingle) for r in got} == {(i, "MIT", i) for i in range(9)}
    assert len({r.containment for r in got}) == 1


def test_rollup_commits_once(spark, tmp_path):
    schema = "op string, doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint"
    change = lambda *rows: spark.createDataFrame([(*r[:2], "s", None, "v1", r[2]) for r in rows], schema)
    rollup = token_rollup.TokenRollup(spark, f"{tmp_path}/rollup")
    total = lambda: [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()]
    assert total() == []
    assert rollup.commit("a", change(("insert", 1, 10), ("insert", 2, 20), ("insert", 2, 20), ("insert", None, 5)))
    assert total() == [(3, 35)]
    assert rollup.commit("b", change(("revise", 1, 7), ("delete", 2, 0), ("delete", 9, 0), ("insert", 3, None)))
    assert total() == [(3, 12)] and not rollup.commit("b", change(("insert", 8, 1000)))
    # A batch that was cut off before its delta was written leaves no trace until it is written again.
    change(("insert", 4, 4)).select(F.lit(4).cast("bigint").alias("doc_id"), "source", "lang", "tokenizer", F.lit(1).alias("sign"), "n_tokens").write.parquet(f"{tmp_path}/rollup/ledger/batch=c")
    assert rollup.live().count() == 2 and total() == [(3, 12)]
    assert rollup.commit("c", change(("insert", 4, 4))) and total() == [(4, 16)]


def test_rollup_reads_finished_batches_and_deletes_win(spark, tmp_path):
    folder = f"{tmp_path}/rollup"
    rollup = token_rollup.TokenRollup(spark, folder)
    schema = "op string, doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, at int"
    change = lambda *rows: spark.createDataFrame([(op, i, "s", "en", "t", n, at) for op, i, n, at in rows], schema)
    total = lambda: [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()]
    assert rollup.totals().count() == rollup.ledger().count() == 0
    rollup.commit("a", change(("insert", 1, 10, 0)))
    # A delta and its ledger rows that were written but not finished are not seen, and are written again.
    for name, extra in (("ledger", "doc_id bigint, source string, lang string, tokenizer string, sign int, n_tokens bigint"),
                        ("delta", "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint")):
        row = (5, "s", "en", "t", 1, 999) if name == "ledger" else ("s", "en", "t", 1, 999)
        spark.createDataFrame([row], extra).write.parquet(f"{folder}/{name}/batch=b")
    os.remove(f"{folder}/delta/batch=b/_SUCCESS")
    assert not rollup.committed("b") and total() == [(1, 10)] and rollup.live().count() == 1
    # Without an order a delete wins; with one, the later row does.
    assert rollup.commit("b", change(("revise", 1, 7, 1), ("delete", 1, 0, 0), ("insert", 2, 4, 0)))
    assert total() == [(1, 4)]
    assert rollup.commit("c", change(("delete", 2, 0, 1), ("revise", 2, 6, 2), ("insert", 3, 9, 1), ("delete", 3, 0, 2)), order="at")
    assert total() == [(1, 6)] and [r.doc_id for r in rollup.live().collect()] == [2]


def test_byte_pair_counts(spark):
    import public_tokenizers

    docs = table(spark, [(1, "hello world", "s"), (2, None, "s")])
    counted = token_rollup.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, name="tokens")
    assert {r.doc_id: r.tokens for r in counted.collect()} == {1: 2, 2: 0}


def test_byte_pair_rollup_equals_brute_force(spark):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    poor, toxic = {r.doc_id for r in labels if r.quality == 0}, {r.doc_id for r in labels if r.toxic == 1}
    want = defaultdict(lambda: [0, 0])
    for r in rows:
        if r.doc_id not in toxic:
            body = re.sub(r"[#*$%&|<>]", "", r.text or "") if r.doc_id in poor else r.text or ""
            want[r.source, r.lang][0] += 1
            want[r.source, r.lang][1] += len(encoding.encode_ordinary(body))
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in QUERIES["token_rollup_byte_pairs"](spark, SMALL).collect()}
    assert got == dict(want)


def test_ablations_from_the_ledger(spark):
    rows = [(1, " ".join(["w#"] * 60), "s"), (2, "few words", "s"), (3, prose(random.Random(9), 80), "s")]
    ledger = quality_rules.ledger(table(spark, rows))
    assert {r.doc_id: r.kept for r in quality_rules.judge(ledger, "strict-1").collect()} == {1: False, 2: False, 3: True}
    cut = {r.rule: (r.n_failed, r.n_only_this) for r in quality_rules.ablations(ledger, "strict-1").collect()}
    assert cut["few_words"] == (1, 1) and cut["symbols"] == (1, 0) and cut["capitals"] == (0, 0)


def test_distrust_reaches_linking_hosts(spark):
    rows = [(i, f"http://spam.bad.net/{i}", None) for i in range(5)] + [(10, "http://good.org/fr/1", '<a href="http://friend.com/">')]
    rows += [(11, "http://farm.com/1", "<a href='http://spam.bad.net/x'>"), (12, "http://friend.com/1", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for piece in (100_000, 1):
        host, path = url_filter.host_and_path("url")
        judged = url_filter.apply_rules(pages.select("page_id", host.alias("host"), path.alias("path"), "html"))
        seeds = judged.groupBy("host").agg(F.count("*").alias("n_all"), F.count(F.when(F.col("fit.verdict") == "allow", 1)).alias("n_allow"), F.count(F.when(F.col("fit.verdict") == "block", 1)).alias("n_block"))
        verdicts = {r.host: r for r in url_filter.judge_hosts(url_filter.propagate(url_filter.host_edges(judged), seeds, piece=piece)).collect()}
        assert verdicts["farm.com"].host_verdict == "block" and verdicts["friend.com"].host_verdict == "allow"
        assert verdicts["friend.com"].trust_share > 0


def test_groups_of_a_sorted_stream():
    import pyarrow as pa

    keys = [1, 1, 2, 3, 3, 3, 3, 4]
    for size in (1, 2, 3, 8):
        batches = pa.Table.from_pydict({"k": keys, "v": list(range(8))}).to_batches(max_chunksize=size)
        got = [part.column("v").to_pylist()[a:b] for part, cuts in text.groups(iter(batches), ["k"]) for a, b in zip(cuts, cuts[1:])]
        assert got == [[0, 1], [2], [3, 4, 5, 6], [7]]
    assert list(text.groups(iter([]), ["k"])) == []


def _exchanged_with_python(df):
    """Rows of ``df`` and the bytes that its plan's operators sent to Python and got back."""
    rows, todo, total = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        for name in ("pythonDataSent", "pythonDataReceived"):
            total += node.metrics().apply(name).value() if node.metrics().contains(name) else 0
    return rows, total


def test_toxicity_stage_sends_a_text_to_python_once(spark, monkeypatch):
    model = toxicity.Model(toxicity.Lexicon({"grobian": 9.0}), tuple(toxicity.PRIOR.values()), toxicity.PRIOR_INTERCEPT)
    monkeypatch.setattr(toxicity, "fit", lambda *_: model)
    rng = random.Random(12)
    rows = [(i, prose(rng, 4000) + (" you grobian." if i % 4 == 0 else ""), "s") for i in range(40)] + [(50, None, "s"), (51, "", None)]
    docs = text.store(table(spark, rows))
    kept, moved = _exchanged_with_python(corpus_pipeline.drop_toxic(spark, docs, SMALL))
    assert Counter(r[:2] for r in kept) == Counter(r[:2] for r in rows if r[0] % 4 or r[0] > 40)
    assert moved < 1.5 * sum(len(r[1] or "") for r in rows)


@pytest.mark.parametrize("own", [None, "1000000"])
def test_toxicity_bounds_the_bytes_of_a_batch(spark, own):
    docs = table(spark, [(1, "one", "s")])
    before = spark.conf.getAll.get(text.BATCH_BYTES)
    spark.conf.unset(text.BATCH_BYTES)
    try:
        if own:
            spark.conf.set(text.BATCH_BYTES, own)
        assert toxicity.with_evidence(docs, toxicity.Lexicon()).count() == 1
        assert spark.conf.get(text.BATCH_BYTES) == (own or str(text.MAX_BATCH))
    finally:
        spark.conf.set(text.BATCH_BYTES, before) if before else spark.conf.unset(text.BATCH_BYTES)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(10)
    item, insult = prose(rng, 20), "grobian"
    rows, labels = [], []
    for i in range(120):
        body = prose(rng, 60, 500)
        if i % 6 == 0:
            body += f" {insult} {insult}."
        if i % 10 == 1:
            body += " " + item[:80]
        if i % 10 == 2:
            body += f" user{i}.x@mail.example.com"
        rows.append((i, body, f"s{i % 3}"))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(200 + i, rows[i][1] + " tail", "s0") for i in (3, 4, 5)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}, None
    for name, stage in corpus_pipeline.STAGES:
        docs = text.store(stage(spark, docs, str(tmp_path)))
        kept[name] = Counter(r.doc_id for r in docs.collect())
        if name == "personal data":
            assert docs.where(F.col("text").contains("@")).count() == 0
            before = docs
    left = {i for i, body, _ in rows if insult not in body}
    assert set(kept["toxicity"]) == left
    left -= {200 + i for i in (3, 4, 5)}
    assert set(kept["near copies"]) == left
    windows = {tuple(item.split()[k : k + 10]) for k in range(11)}
    left = {i for i in left if not any(tuple(words(rows[i][1])[k : k + 10]) in windows for k in range(len(words(rows[i][1])) - 9))}
    assert set(kept["decontamination"]) == set(kept["personal data"]) == left
    sizes = {r.doc_id: len(words(r.text)) for r in before.collect()}
    taken = sum(sizes[i] * n for i, n in kept["mixture"].items())
    assert abs(taken - 1.5 * sum(sizes.values())) < 3 * max(sizes.values()) and max(kept["mixture"].values()) <= 2
    assert np.isfinite(taken)


class _AskedLexicon(toxicity.Lexicon):
    def entries(self, word):
        ASKED[word] += 1
        return super().entries(word)


ASKED = Counter()


def test_toxicity_judges_a_word_once_per_batch():
    lexicon = _AskedLexicon({"idiot": 2.0, "größe": 1.0}, {"lowei": 1.5, "naï": 1.0, "lo": 0.5})
    rows = [["idiot", "plain", "loweixy"], [], ["plain", "größe"], ["x", "plain"]] * 50
    ASKED.clear()
    held = toxicity._held(pa.array(rows, pa.list_(pa.string())), lexicon)
    assert held == [{e for w in row for e in toxicity.Lexicon.entries(lexicon, w)} for row in rows]
    assert set(ASKED) == {w for row in rows for w in row} and max(ASKED.values()) == 1
    texts = [None, "", "Nothing here", "You IDIOT! fine", "so “naïf”lowei²x 7idiot_", "lOWEI5naï", "x½größe. not größe", "İdiot\nkill", "lo"]
    texts += [" ".join(f"w{i % 7}é q\x85z" for i in range(30))] * 40
    matcher = toxicity.Matcher(lexicon)
    ASKED.clear()
    found = matcher.evidences(texts)
    assert max(ASKED.values()) <= 4 and sum(map(any, found)) == 6
    assert found == [matcher.evidence(t) for t in texts]
    assert matcher.evidences(texts * 11) == found * 11 and len(texts) * 11 > 2 * toxicity.PIECE
    assert matcher.evidences([]) == [] and matcher.evidences([None, ""]) == [[0.0] * len(toxicity.KINDS)] * 2
    # A slice of a column, as batches may be, counts from its own begin.
    assert toxicity._held(pa.array(rows, pa.list_(pa.string())).slice(2, 3), lexicon) == held[2:5]
