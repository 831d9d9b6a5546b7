"""Token files, periodic runs and ranked search: awkward rows, brute force, SQL and round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from checks.compare import connect, rows
from playtally.llm import period_runs, ranked_search, token_files
from playtally.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
# Extra columns clash with names that operators use inside.
SCHEMA = "doc_id long, text string, row long, tiled string, kept int, runs int, n long, term string, `a.b` int"
PERIODIC = " ".join(["one two three four five six seven"] * 6)
ROWS = [
    (None, PERIODIC),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, PERIODIC + " end"),
    (4, PERIODIC + " end"),
    (5, "Ünïcödé 語 two\x0bparts\x0cthree é it's 'll <|endoftext|> a1b22"),
    (6, ("word " * 40000).strip()),
    (-7, "one TWO three"),
    (8, "x" * 70000),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 1, "t", 2, 3, 4, "u", 5) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ids_of(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


# Token files


def test_token_files_of_awkward_rows(spark, awkward, tmp_path):
    folder = f"file://{tmp_path}/set"
    token_files.write(awkward, folder, tokenizer_path("word_bpe_49k.json"))
    found = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, -7, 1, 2, 3, 4, 4, 5, 6, 8]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter(
        (i, len(ids_of(t)), crc(ids_of(t))) for i, t in ROWS
    )
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:k]) for k in range(len(found))]
    files = token_files.TokenFiles(folder)
    assert len(files) == len(ROWS) and files.document(2).tolist() == ids_of("one TWO three")
    whole = [x for k in range(len(files)) for x in files.document(k).tolist()]
    assert files.tokens == len(whole)
    for start, length in [(0, len(whole)), (0, 0), (3, 50), (len(whole) - 5, 5)]:
        assert files.window(start, length).tolist() == whole[start : start + length]
    with pytest.raises(IndexError):
        files.document(len(files))


def test_token_files_of_no_rows(spark, awkward, tmp_path):
    token_files.write(awkward.where("false"), str(tmp_path / "set"), tokenizer_path("word_bpe_49k.json"))
    assert token_files.read(spark, str(tmp_path / "set")).collect() == []
    assert len(token_files.TokenFiles(str(tmp_path / "set"))) == 0


def test_token_files_hold_the_ids_of_every_document(spark, texts):
    found = {r.doc_id: r for r in QUERIES["op13_token_files"](spark, FOLDER).collect()}
    at = 0
    for doc in sorted(texts):
        ids = ids_of(texts[doc])
        assert found[doc] == (doc, at, len(ids), crc(ids))
        at += len(ids)
    assert len(found) == len(texts)


def test_words_are_encoded_as_in_their_text():
    rng, encoder = random.Random(3), token_files.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    pieces = ["a", "É", "é", "́", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " "]
    pieces += ["'s", "'", "’ll", "12", "語", "σΣ", "İ", "<|endoftext|>", "<|", "ﬁ", "🙂", "-", "word", "​", "̣"]
    letters = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA1, 0x180)]]
    for k in range(6000):
        text = "".join(rng.choices((pieces, letters, "'slmdtrveaAÉ1!? ")[k % 3], k=rng.randrange(12)))
        assert encoder.ids(text) == b"".join(x.to_bytes(4, "little") for x in ids_of_cached(text)), repr(text)


_TOKENIZER = []


def ids_of_cached(text):
    from tokenizers import Tokenizer

    if not _TOKENIZER:
        _TOKENIZER.append(Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")))
        _TOKENIZER[0].encode_special_tokens = True
    return _TOKENIZER[0].encode(text, add_special_tokens=False).ids


# Periodic runs


def brute_runs(words, shortest=24, least=3):
    found = {}
    for p in range(1, len(words) // least + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(shortest, least * p):
                found[i, length] = min(p, found.get((i, length), p))
            i = max(j, i + 1)
    return sorted((start, p, length) for (start, length), p in found.items())


def brute_collapsed(words, runs):
    gone = {i for start, p, length in runs for i in range(start + p, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_awkward_rows(spark, awkward):
    found = period_runs.find_runs(awkward)
    assert found.columns == [*awkward.columns, "_n_words", "_runs", "_collapsed"]
    found = found.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(ROWS)
    for r in found:
        words = BLANK.findall(r.text or "")
        runs = [(0, 1, 40000)] if r.doc_id == 6 else brute_runs(words)
        assert [(x.start, x.period, x.length) for x in r._runs] == runs
        assert (r._n_words, r._collapsed) == (len(words), brute_collapsed(words, runs))
        assert (r.row, r.tiled, r.kept, r.runs, r["a.b"]) == (1, "t", 2, 3, 5)
    assert period_runs.find_runs(awkward.where("false")).collect() == []
    with pytest.raises(ValueError):
        period_runs.find_runs(awkward, shortest=10)


def test_runs_against_brute_force(spark):
    rng, docs = random.Random(12), []
    for k in range(400):
        letters = rng.choice([1, 2, 3, 30])
        words = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(150))]
        for _ in range(rng.randrange(4)):
            unit = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(1, 50))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [unit[i % len(unit)] for i in range(int(len(unit) * rng.uniform(2.5, 7)))]
        docs.append((k, " ".join(words)))
    found = period_runs.find_runs(spark.createDataFrame(docs, "id long, text string").repartition(8))
    count = 0
    for r in found.collect():
        words = r.text.split()
        runs = brute_runs(words)
        count += len(runs)
        assert [(x.start, x.period, x.length) for x in r._runs] == runs
        assert r._collapsed == brute_collapsed(words, runs)
    assert count > 300


def test_the_query_of_periodic_runs(spark, texts):
    found = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    assert len(found) == len(texts)
    changed = 0
    for doc, text in texts.items():
        words = BLANK.findall(text)
        n, h = len(words), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            changed += 1
        runs = brute_runs(words)
        best = max(runs, key=lambda x: (x[2] / x[1], -x[0], -x[1]), default=None)
        r = found[doc]
        assert r.n_runs == len(runs)
        listed = "".join(f"{s},{length},{p}\n" for s, p, length in runs)
        assert r.runs_sha256 == sha(listed.encode())
        assert r.collapsed_sha256 == sha(brute_collapsed(words, runs).encode())
        expected = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        assert (r.start, r.length, r.period, r.exponent_milli) == expected
    assert changed > 5


def test_the_strongest_run_is_exact(spark):
    runs = [(5, 30, 10), (7, 60, 20), (2, 31, 10), (3, 62, 20)]
    frame = spark.createDataFrame([(sorted(runs),), ([],), (None,)], f"r {period_runs.RUNS}")
    best = [r[0] for r in frame.select(period_runs.strongest(frame.r)).collect()]
    assert tuple(best[0]) == (2, 31, 10) and best[1:] == [None, None]


# Ranked search


def brute_search(docs, items, best=10):
    found = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t in docs if t]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    frequency = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, counts in found:
            m, score = 25 + 75 * sum(counts.values()) * n // total, 0
            for term in TERM.findall((text or "").translate(LOWER)):
                if tf := counts[term]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * frequency[term] + 1)))
                    score += w * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        scores.sort(key=lambda x: x[:3])
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(scores[:best])]
    return Counter(out)


def test_search_of_awkward_rows(spark, awkward):
    items = [(1, "One two TWO seven"), (1, "語 22 a1b22"), (None, "word"), (3, None), (4, "!"), (5, "nowhere"), (6, "x")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = Counter(tuple(r) for r in ranked_search.search(awkward, asked).collect())
    assert found == brute_search(ROWS, items) and sum(found.values()) == 7
    assert ranked_search.search(awkward.where("false"), asked).collect() == []
    assert ranked_search.search(awkward, asked.where("false")).collect() == []


def test_search_equals_brute_force_over_blocks_and_shards(spark, texts, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(ranked_search, "SHARD_TERMS", 2000)
    monkeypatch.setattr(ranked_search, "HELD", 5000)
    docs, items = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    expected = brute_search(texts.items(), [tuple(r) for r in items.select("item_id", "text").collect()])
    assert Counter(tuple(r) for r in ranked_search.search(docs, items).collect()) == expected


def test_search_equals_its_twin(spark):
    name = "op11_ranked_search"
    frame = QUERIES[name](spark, FOLDER)
    with connect(FOLDER) as connection:
        cursor = connection.execute(ORACLE_SQL[name])
        theirs = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == theirs


def test_shared_sums_add_up_to_their_items():
    rng = random.Random(11)
    items = [Counter(int(rng.paretovariate(0.7)) % 60 for _ in range(rng.randrange(40))) for _ in range(80)]
    sums, made, first = ranked_search.share(items)
    known: dict[int, Counter] = defaultdict(Counter)
    for k in range(first):
        known[k][k] = 1
    for k, parts in enumerate(sums):
        assert all(x < first + k for x in parts)
        for x in parts:
            known[first + k].update(known[x])
    for item, parts in zip(items, made, strict=True):
        total = Counter()
        for x in parts:
            total.update(known[x])
        assert total == item
    before = sum(x.total() for x in items)
    assert sum(map(len, [*sums, *made])) < 0.8 * before
