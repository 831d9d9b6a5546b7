"""Every operator on awkward rows, and against brute force on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from checks.compare import connect, rows
from playtally.llm import (
    decontaminate,
    language_id,
    line_dedup,
    near_dedup,
    packing,
    pseudonyms,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    window_dedup,
)
from playtally.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from tests.conftest import plan_of

FOLDER = "/root/testdata/sf0.001"
SENTENCE = "every copy of this sentence has more than twenty words so that windows of words and of bytes are found in it more than once today"
# Extra columns clash with names that operators use inside.
SCHEMA = "doc_id long, text string, start int, N int, h string, sig string, place string, n_words string"
ROWS = [
    (None, SENTENCE),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, SENTENCE),
    (4, SENTENCE),
    (5, SENTENCE + "\n" + SENTENCE),
    (6, ("word " * 40000).strip()),
    (7, "Ünïcödé 語 mail a@b.example.com " + SENTENCE),
    (8, SENTENCE.replace("copy", "kopie")),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 1, 2, "h", "s", "p", "w") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(4, 1, 0), (4, 1, 0), (6, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int"
    )


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, SENTENCE), (1, None), (None, "!!"), (2, "Mail")], "item_id long, text string")


def operators(spark, labels, benchmark):
    return {
        "pack": lambda d: packing.pack(d, tokenizer_path()),
        "judge": lambda d: quality_rules.judge(d, quality_rules.trusted_documents(labels)),
        "windows": window_dedup.remove_repeats,
        "language": lambda d: language_id.predict(d, language_id.learn(d.selectExpr("text", "'en' AS lang"))),
        "suffixes": suffix_dedup.remove_repeats,
        "lines": line_dedup.dedup_lines,
        "benchmark": lambda d: decontaminate.contamination(d, benchmark),
        "near": near_dedup.near_duplicates,
        "quality": lambda d: quality_classifier.score(d, quality_classifier.fit(d, labels)),
        "pseudonyms": lambda d: pseudonyms.pseudonymise(d, b"k"),
    }


NAMES = list(operators(None, None, None))


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, awkward, labels, benchmark, name):
    found = operators(spark, labels, benchmark)[name](awkward).collect()
    if name == "pack":
        assert Counter(r.doc_id for r in found if r.start == 0) == Counter(i for i, _ in ROWS)
        assert {r.doc_tokens for r in found if r.doc_id in (1, 2)} == {1}
        return
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in ROWS)
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    if name == "judge":
        assert all(r._quality.base_failed for i in (1, 2, 3, 6) for r in by[i]) and by[4][0].N == 2
    if name == "windows":
        assert {r.n_removed for r in by[4]} == {26} and by[6][0].n_removed == 39999
        assert max(r.n_removed for r in by[None]) == 0
    if name == "language":
        assert by[1][0].lang_pred == "und" and by[7][0].lang_pred == "en"
    if name == "suffixes":
        size = len(SENTENCE)
        assert {r.n_removed for r in by[4]} == {size} and by[5][0].n_removed == 2 * size
        assert by[1][0].n_bytes == 0 and by[1][0].n_removed == 0
    if name == "lines":
        assert {r.text for r in by[4]} == {""} and by[8][0].text == "" and by[1][0].text is None
        assert by[7][0]._n_removed == 0 and by[5][0]._n_removed == 2 and by[5][0].start == 1
    if name == "benchmark":
        assert by[4][0].contaminated and by[4][0].items == [1] and by[7][0].items == [1, 2]
        assert by[1][0].n_words == 0 and not by[1][0].contaminated and not by[6][0].contaminated
    if name == "near":
        assert {r.component_id for r in by[4]} == {4} and all(r.component_id is None for r in by[None])
        assert by[2][0].n_shingles == 0 and by[2][0].kept
    if name == "quality":
        assert all(0 <= r.score <= 1 for r in found)
    if name == "pseudonyms":
        assert by[1][0].text is None and "@b.example.com" in by[7][0].text and by[7][0].sig == "s"


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, awkward, labels, benchmark, name):
    assert operators(spark, labels.limit(0), benchmark.limit(0))[name](awkward.where("false")).collect() == []


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    found = QUERIES["op1_packing"](spark, FOLDER).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids, at = [*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r.start):
            data = b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length])
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(data))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for r in found) > 0.95 * 2048 * len(sequences)


def test_quality_rules(spark, texts):
    found = {r.doc_id: r for r in QUERIES["op2_quality_rules"](spark, FOLDER).collect()}
    for doc, text in texts.items():
        words = BLANK.findall(text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        twice = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        own = [x for x in text.split("\n") if BLANK.search(x)]
        r = found[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words),
            sum(map(len, words)),
            len(re.findall(r"[#*$%&|<>]", text)),
            len(own) - len(set(own)),
            len(twice),
        )
        failed = len(words) < 20 or 100 * len(twice) > 30 * len(words)
        assert r.base_failed == failed and not (failed and r.kept)
        assert r.kept == (not failed and r.score >= quality_rules.THRESHOLD)


def test_window_and_suffix_dedup(spark, texts):
    words = {r.doc_id: r for r in QUERIES["op3_window_dedup"](spark, FOLDER).collect()}
    suffixes = {r.doc_id: r for r in QUERIES["op5_suffix_dedup"](spark, FOLDER).collect()}
    seen_words, seen_bytes = set(), set()
    for doc in sorted(texts):
        own, gone = BLANK.findall(texts[doc]), set()
        for i in range(len(own) - 19):
            key = tuple(own[i : i + 20])
            gone.update(range(i, i + 20) if key in seen_words else ())
            seen_words.add(key)
        kept = " ".join(w for i, w in enumerate(own) if i not in gone).encode()
        r = words[doc]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(own), len(gone), sha(kept))
        data = texts[doc].encode()
        mark = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen_bytes:
                mark[i : i + 100] = b"\1" * 100
            seen_bytes.add(data[i : i + 100])
        kept = bytes(c for c, m in zip(data, mark, strict=True) if not m)
        spans = len(re.findall(b"\1+", bytes(mark)))
        r = suffixes[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), sum(mark), spans, sha(kept))


def test_decontamination(spark, texts):
    item = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for b in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = item.findall((b.text or "").translate(LOWER))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(b.item_id)
    found = {r.doc_id: r for r in QUERIES["op7_decontamination"](spark, FOLDER).collect()}
    for doc, text in texts.items():
        w, hit, items = item.findall(text.translate(LOWER)), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    items |= windows[key]
        r = found[doc]
        listed = sha(",".join(sorted(map(str, items))).encode())
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(items), listed)
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_near_dedup(spark, texts):
    sets = {}
    for doc, text in texts.items():
        w = BLANK.findall(text.translate(LOWER))
        sets[doc] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for r in QUERIES["op8_near_dedup"](spark, FOLDER).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_a_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(300)]
    docs = [(k, " ".join([*base[: k % 290], f"x{k}", *base[k % 290 + 1 :]])) for k in range(400)]
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}


def brute_components(docs, percent=85):
    sets = {}
    for doc, text in docs:
        w = text.split()
        sets[doc] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in sets}


def test_links_inside_a_template_family(spark):
    # Every two fillings of one form lie just below the threshold; some have a copy just above it.
    rng, docs = random.Random(8), []
    for k in range(700):
        words = [f"w{i}" for i in range(240)]
        for slot in range(7):
            words[15 + 32 * slot] = f"f{slot}.{k}"
        docs.append((2 * k, " ".join(words)))
        if k % 10 == 0:
            for slot in rng.sample(range(7), 6):
                words[15 + 32 * slot] = f"c{slot}.{k}"
            docs.append((2 * k + 1, " ".join(words)))
    expected = brute_components(docs)
    assert len(set(expected.values())) == 700
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8))
    assert {r.doc_id: r.component_id for r in found.collect()} == expected


def test_members_of_a_closed_node_are_joined_exactly(spark):
    # All agree in nine tokens of ten or more by estimate, which their sets need not; one root, so no other path.
    like = bytes(range(near_dedup.TOKENS))
    rows = [(k, like if k % 2 else like[:-9] + bytes([255 - k] * 9), [7]) for k in range(60)]
    sketches = spark.createDataFrame(rows, "doc_id long, sig binary, roots array<long>")
    pairs, rest = near_dedup.candidates(sketches)
    assert pairs.count() == 59 and sorted(r.doc_id for r in rest.collect()) == list(range(60))


def test_a_large_node_goes_down_once_and_in_proportion(spark, monkeypatch):
    plans, down, real = [], [], near_dedup.stored

    def watched(frame, *args):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        frame = real(frame, *args)
        if frame.columns == ["node", "doc_id"]:
            down.append(frame.count())
        return frame

    monkeypatch.setattr(near_dedup, "stored", watched)
    rng = random.Random(4)
    for n in (100, 200):
        # Nobody is near to anybody, and most tokens agree, so the node stays large on every level.
        rows = [(k, bytes(rng.choice((0, 0, 0, 1)) for _ in range(near_dedup.TOKENS)), [7]) for k in range(n)]
        down.clear()
        near_dedup.candidates(spark.createDataFrame(rows, "doc_id long, sig binary, roots array<long>"))
        assert len(down) == near_dedup.DEEP - 1 and all(x <= y * n for x, y in zip(down, (2, 4, 4), strict=True))
    # The members and the sizes of a level's nodes come from one pass over the level above.
    assert max(x.count("MapInArrow") for x in plans) == 1 and max(x.count("LeftSemi") for x in plans) == 1


def test_near_copies_among_strangers_are_not_sent_down(spark, monkeypatch):
    sent, real = [], near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda frame, *args: sent.append(frame.columns) or real(frame, *args))
    rng, rows = random.Random(5), []
    base = rng.randbytes(near_dedup.TOKENS)
    for k in range(200):
        sig = bytearray(base if k < 120 else rng.randbytes(near_dedup.TOKENS))
        for place in rng.sample(range(near_dedup.TOKENS), 4):
            sig[place] = rng.randrange(256)
        rows.append((k, bytes(sig), [7]))
    pairs, rest = near_dedup.candidates(spark.createDataFrame(rows, "doc_id long, sig binary, roots array<long>"))
    # Every copy but the first head has one pair, which ties them together; all meet in the exact join.
    assert ["node", "doc_id"] not in sent and sorted(r.doc_id for r in rest.collect()) == list(range(200))
    parent = {k: k for k in range(120)}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [(r.a, r.b) for r in pairs.collect()]
    for a, b in links:
        parent[root(b)] = root(a)
    assert len(links) == 119 and len({root(k) for k in parent}) == 1


def test_a_member_takes_the_likest_head(spark):
    rng = random.Random(6)
    base = rng.randbytes(near_dedup.TOKENS)
    rows = []
    for k in range(1500):
        sig = bytearray(base)
        for place in rng.sample(range(near_dedup.TOKENS), rng.randrange(40)):
            sig[place] = rng.randrange(256)
        rows.append((k, bytes(sig), [7]))
    seen = []
    for k in range(0, 1500, 30):
        seen.append({"slot": k // 30 % near_dedup.HEADS, "doc_id": k, "sig": rows[k][1]})
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([7] * len(rows)),
            pa.array([r[0] for r in rows]),
            pa.array([r[1] for r in rows]),
            pa.array([seen[: 1 + k % 24] for k in range(len(rows))]),
        ],
        ["node", "doc_id", "sig", "heads"],
    )
    found = pa.Table.from_batches(near_dedup._compare_heads(iter([batch]))).to_pylist()
    for r, (k, sig, _) in zip(found, rows, strict=True):
        heads = seen[: 1 + k % 24]
        before = next((i for i, x in enumerate(heads) if x["doc_id"] == k), len(heads))
        equal = [sum(x == y for x, y in zip(sig, h["sig"], strict=True)) / near_dedup.TOKENS for h in heads[:before]]
        best = (heads[equal.index(max(equal))]["doc_id"], max(equal)) if equal else (k, 1)
        assert (r["doc_id"], r["head"]) == (k, best[0]) and abs(r["share"] - best[1]) < 1e-9


def test_short_lines_go_if_they_are_equal(spark):
    docs = [(1, "read  more\n \nshare this page now\nok"), (2, "read more\n \nshare that page now\nok\nok then")]
    found = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r._n_removed) for r in found} == {
        1: (docs[0][1], 0),
        2: (" \nshare that page now\nok then", 2),
    }


def test_line_dedup_equals_its_twin(spark):
    name = "op6_line_dedup"
    frame = QUERIES[name](spark, FOLDER)
    with connect(FOLDER) as connection:
        cursor = connection.execute(ORACLE_SQL[name])
        theirs = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == theirs


def near_lines(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(docs):
    every = [(i, k, line.split()) for i, text in docs for k, line in enumerate(text.split("\n")) if line.split()]
    gone = Counter()
    for at, (i, _, words) in enumerate(every):
        gone[i] += any(
            words == other or (min(len(words), len(other)) >= 5 and near_lines(words, other)) for _, _, other in every[:at]
        )
    return {i: gone[i] for i, _ in docs}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 12)):
            line = [rng.choice("ab") if rng.random() < 0.8 else "a-long-word-of-hashes" for _ in range(rng.randint(0, 11))]
            lines.append(rng.choice((" ", "\t", " \r ")).join(line) + rng.choice(("", " ", "\x00")))
        docs.append((i, "\n".join(lines)))
    found = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r._n_removed for r in found} == brute_lines(docs)


def test_line_dedup_cuts_the_variants_off(spark):
    """The last job, which shuffles whole texts, does not hold the shuffles of the variants as well."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    # Lines become rows again to be found, variants do not.
    assert plan_of(line_dedup.dedup_lines(docs)).count(") Generate") == 1


def test_line_dedup_hashes_lines_once(spark):
    """Lines are split for their hashes before the cut; their verdicts are found without the texts."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = plan_of(line_dedup.removed_lines(docs, 5, "doc_id", "text", 1))
    assert "split(" not in plan and "text" not in plan


def test_runs_of_blanks_are_one_space(column):
    texts = ["a b", " a  b ", "a\t\x0b\f\r b\n\n  c   d\x0b", "\x0b\f", "\f\x0b a\x0b\fb \n", "   \n \r\na", "\u00a0  \u3000"]
    found = column(texts, "string", line_dedup._lines)
    assert found == [re.sub("[ \t\x0b\f\r]+", " ", x).split("\n") for x in texts]


@pytest.mark.parametrize(
    ("text", "kind", "left"),
    [
        ("4111111111111111 123", "card", " 123"),
        ("4111 1111 1111 1111 12/27", "card", " 12/27"),
        ("no 123 4111111111111111.", "card", "no 123 "),
        ("12 34 56 4111-1111-1111-1111", "card", "12 34 56 "),
        ("3782 822463 10005 7 x", "card", " 7 x"),
        ("2021-03-04T10:00", "date", "T10:00"),
        ('TOKEN = "9233A8EC9233A8EC9233A8EC9233A8EC"', "secret", 'TOKEN = "'),
        ("9233a8EC9233A8EC9233A8EC9233A8EC", "secret", ""),
    ],
)
def test_values_beside_other_characters(text, kind, left):
    for key in range(50):
        counts, back = dict.fromkeys(pseudonyms.KINDS, 0), dict.fromkeys(pseudonyms.KINDS, 0)
        new = pseudonyms.change(text, pseudonyms.Feistel(bytes([key])), counts)
        assert new != text and left in new and len(new) == len(text)
        assert counts == back | {kind: 1}
        assert pseudonyms.change(new, pseudonyms.Feistel(bytes([key]), reverse=True), back) == text


def test_models_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    right = found.join(docs, "doc_id").selectExpr("avg(int(lang_pred = lang))").first()[0]
    assert right > 0.97
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = QUERIES["op9_quality_classifier"](spark, "/root/testdata/sf0.01").where("held_out")
    assert found.join(labels, "doc_id").selectExpr("avg(int(predicted = quality))").first()[0] > 0.9


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    judged = {r.doc_id for r in QUERIES["op2_quality_rules"](spark, FOLDER).where("kept").collect()}
    packed = corpus_pipeline.run(spark, FOLDER)
    kept = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert kept and kept <= judged
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns


def test_a_filter_on_the_verdict_stays_above_it(spark, awkward, labels):
    judged = quality_rules.judge(awkward, quality_rules.trusted_documents(labels))
    for kept in (judged, judged.where("_quality.kept").select(awkward.columns)):
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") <= 4 and plan.count("xxhash64(") <= 8


def test_stages_on_awkward_rows(spark, awkward, tmp_path):
    # Columns clash with names that the stages use inside.
    docs = awkward.selectExpr("*", "1 AS _gone", "'x' AS _judged_id", "2 AS _judged_text", "3 AS n_chars")
    spark.createDataFrame([(4, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    spark.createDataFrame([(1, SENTENCE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = {}
    for name in ("quality_rules", "line_dedup", "near_dedup", "decontamination"):
        found = stages[name](spark, docs, str(tmp_path))
        assert found.columns == docs.columns
        ids[name] = Counter(r.doc_id for r in found.collect())
        assert stages[name](spark, docs.where("false"), str(tmp_path)).collect() == []
    assert ids["quality_rules"] == Counter({None: 1, 4: 2, 7: 1, 8: 1})
    # The earliest row of the sentence has no id, so all others lose it, and with it their last words.
    assert ids["line_dedup"] == Counter({None: 2, 1: 1, 2: 1, 3: 1, 6: 1, 7: 1})
    # One word of 26 changed makes three shingles of 24; words before the sentence make as few as four.
    assert ids["near_dedup"] == Counter({None: 2, 1: 1, 2: 1, 3: 1, 4: 2, 6: 1, 8: 1})
    assert ids["decontamination"] == Counter({None: 1, 1: 1, 2: 1, 3: 1, 6: 1})
    assert {r.doc_id for r in stages["packing"](spark, docs, str(tmp_path)).collect()} == {i for i, _ in ROWS}


def test_a_card_has_one_pseudonym_in_every_context():
    rng = random.Random(10)
    before = ["", "card ", "no 12 ", "7 ", "12 34 ", "(", "2021 ", "x: 5 "]
    behind = ["", ".", " 1", " 12", " 123", " 12/27", ", 4", " 7 8 9", ")", " end"]
    for length in (13, 14, 15, 16, 19):
        for _ in range(25):
            body = str(rng.randrange(10 ** (length - 2), 10 ** (length - 1)))
            card = body + str(pseudonyms._luhn(body))
            found = set()
            for a in before:
                for b in behind:
                    counts = dict.fromkeys(pseudonyms.KINDS, 0)
                    new = pseudonyms.change(a + card + b, pseudonyms.Feistel(b"k"), counts)
                    assert new.startswith(a) and new.endswith(b) and counts["card"] == 1
                    found.add(new[len(a) : len(new) - len(b)])
                    back = pseudonyms.change(new, pseudonyms.Feistel(b"k", reverse=True), dict(counts))
                    assert back == a + card + b
            assert len(found) == 1 and card not in found
