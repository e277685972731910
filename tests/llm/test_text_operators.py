"""Each text operator against brute force, an exact round trip or held-out accuracy, and on odd inputs."""

import cProfile
import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from chronofold.llm import idfiles, language, lines, neighbours, ngram_join, packing, privacy, quality, urls, wordpieces
from chronofold.llm.common import connected, fresh_path
from chronofold.llm.shingles import shingle_set

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, n string"
ODD = ["", None, " \n\t ", "one", "a b c d", "A  b\x0bc\r\nD e", "ΑΣ İstanbul ßẞ ǅ don't <|endoftext|>x", "日本語 😀👍🏽 \x1c \x85", "a@b.c " * 3, "x" * 30_000, "word " * 6_000, "tab\tsep  two   spaces \n\n end"]


def odd_docs(spark):
    rows = [(i if i != 3 else None, t, None, "s", 1, "k", "i", "n") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [rows[4], rows[10]], SCHEMA)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(wordpieces.vocabulary(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_urls_fit_hosts_at_label_borders(spark):
    listed = spark.createDataFrame(urls.RULES + [("com", "/", "allow")], "host string, path string, verdict string")
    cases = ["http://WWW.Example.com/en/x?q", "http://badexample.com/en/", "https://example.com/en", "x", None, "a://b.net/es/#", "a://b.net/esx", "://net/fr/", "a://xnet/fr/", "a://h?x://com/", "a://com"]
    want = ["www.example.com/en/", "com/", "com/", None, None, "net/es/", None, "net/fr/", None, None, None]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(cases)] + [(0, cases[0], "z")], "page_id long, url string, rule string")
    got = urls.judge(pages, listed).collect()
    assert len(got) == len(cases) + 1
    assert {r.id: r.rule for r in got} == dict(enumerate(want))
    assert {r.verdict for r in got if r.rule is None} == {"allow"}
    assert urls.judge(pages.limit(0), listed).count() == 0
    assert {r.rule for r in urls.judge(pages, listed.limit(0)).collect()} == {None}


def test_urls_join_by_shuffle_gives_the_same(spark, monkeypatch):
    listed = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    small = sorted(map(tuple, urls.judge(pages, listed).collect()))
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, urls.judge(pages, listed).collect())) == small


def test_privacy_patterns():
    text = "a.b+c@x-y.org, @z.q x@y 1.2.3.4.5.6.7.8 256.1.1.1 x 4111 1111-1111 1111 x 4111111111111112 x +1 (743) 555-3824 +1 2"
    want = []
    for kind, pattern in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and privacy.luhn(digits), 10 <= len(digits) <= 15][kind]
            want += [(m.start(), m.end(), kind)] * good
    assert privacy.base_spans(text) == sorted(want, key=lambda s: (s[0], s[2]))
    assert [text[a:b] for a, b, _ in want][:2] == ["a.b+c@x-y.org", "1.2.3.4"]
    assert privacy.clean(text, privacy.base_spans(text)).startswith("<EMAIL>, @z.q x@y <IP>.<IP> 256.1.1.1 x <CARD> x 4111111111111112 x <PHONE>")


def test_privacy_disclosing_terms(spark):
    rng = np.random.default_rng(1)
    filler = [" ".join(rng.choice(list("pqrstuvw"), 12)) for _ in range(60)]
    words = ["alpha", "beta", "gamma", "delta", "common"]
    plain = [f"common {f} some text number {i}" for i, f in enumerate(filler)]
    told = [f"common {words[i % 4]}{'xyz'[i % 3]} the Zorblatt writes from z@corp.org to word{'abcdefgh'[i]}" for i in range(8)]
    copies = [told[0].replace("z@corp.org", "q@corp.org").replace("Zorblatt", "Quux")] * 9
    docs = docs_of(spark, plain + told + copies + ["Only Zorblatt here", None, ""])
    shares = {r.term: r.share for r in privacy.disclosing_terms(docs).collect()}
    assert "zorblatt" in shares and "common" not in shares and "quux" not in shares
    n, n_e, n_t = len(plain) + len(told) + 3, 8, 9  # of the copies one, the text beside them, and the empty one
    assert shares["zorblatt"] == pytest.approx(np.log(n * 8 / (n_e * n_t)) / np.log(n / n_e))
    terms = spark.createDataFrame([("zorblatt", shares["zorblatt"])], "term string, share double")
    found = {r.id: r for r in privacy.find(docs, terms).collect()}
    assert [(s.start, s.stop, s.kind) for s in found[len(plain + told + copies)].spans] == [(5, 13, 4 + (shares["zorblatt"] >= privacy.REMOVE))]
    cleaned = {r.doc_id: r.text for r in privacy.sanitise(docs, terms).collect()}
    assert "Zorblatt" not in "".join(filter(None, cleaned.values())) and "z@corp.org" not in cleaned[60]
    assert cleaned[0] == plain[0] and cleaned[docs.count() - 2] is None
    assert privacy.disclosing_terms(empty(spark)).count() == 0


def test_privacy_copies_hide_no_term(spark, monkeypatch):
    plain = [f"some text number {i} with word{'abcdefgh'[i % 8]}" for i in range(100)]
    told = [f"{w} the Zorblatt writes from z@corp.org" for w in ("alpha", "beta", "gamma", "delta", "omega")]
    docs = docs_of(spark, plain + told + told[:1] * 2000)
    want = {r.term: r.share for r in privacy.disclosing_terms(docs).collect()}
    assert want["zorblatt"] == pytest.approx(1.0)
    monkeypatch.setattr(privacy, "TERMS_AT_ONCE", 2)
    assert {r.term: r.share for r in privacy.disclosing_terms(docs).collect()} == pytest.approx(want)


def test_privacy_query_equals_plain_patterns(spark, tmp_path):
    """The base kinds of the query against regular expressions read as the contract has them, term spans by the shares."""
    texts = [*ODD, "mail a.b@c.de, call +1 (743) 555-3824 or 4111 1111 1111 1111; 10.0.0.1, 10.0.0.999", "é😀 x@y.z x@y.z", *(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect())]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    terms = {r.term: r.share for r in privacy.disclosing_terms(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda m: re.sub("[^0-9]", "", m)
    good = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 14 <= len(digits(m)) <= 19 and privacy.luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15}
    for r in privacy.op2_privacy(spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        base = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, text) if good[k](m[0]))
        written = [f"{k}:{a}:{b}" for a, _, b, k in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[3] for x in base) for k in kinds)
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in kinds] == written
        for kind, a, b in (s.split(":") for s in spans if s.split(":")[0] not in kinds):
            assert (kind == "gone") == (terms[text[int(a) : int(b)].lower()] >= privacy.REMOVE)


def test_packing_query_digests_every_piece(spark, library):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    found: dict = {}
    for r in packing.op3_packing(spark, SF).collect():
        found.setdefault(r.doc_id, []).append(r)
        assert r.offset == 0 and r.length in {1 << k for k in range(12)}
    assert set(found) == set(texts)
    for doc, own in found.items():
        ids, at = np.array([*ids_of(library["word_bpe_49k.json"], texts[doc]), packing.END_ID], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_privacy_in_parts_gives_the_same(spark, monkeypatch):
    docs = docs_of(spark, ["alpha beta gamma", "beta x@y.z delta", None])
    terms = spark.createDataFrame([("alpha", 0.8), ("beta", 0.99), ("delta", 0.8)], "term string, share double")
    whole = sorted(map(str, privacy.find(docs, terms).collect()))
    cleaned = [r.text for r in privacy.sanitise(docs, terms).collect()]
    monkeypatch.setattr(privacy, "TERMS_AT_ONCE", 1)
    assert sorted(map(str, privacy.find(docs, terms).collect())) == whole
    assert [r.text for r in privacy.sanitise(docs, terms).collect()] == cleaned == ["<TERM>  gamma", " <EMAIL> <TERM>", None]


def test_batches_leave_the_session_as_it_is(spark):
    from chronofold.llm.common import map_batches

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = map_batches(spark.range(100).coalesce(1), lambda b: b.set_column(0, "id", [b.num_rows] * b.num_rows), "id long", rows=30)
    assert {r.id for r in sizes.collect()} == {30, 10} and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoders_equal_the_library(library, name):
    rng = np.random.default_rng(3)
    random = ["".join(rng.choice(list("ab 'st\n\téİǅΣ<|>endoftx́ 1"), 60)) for _ in range(400)]
    texts = [t or "" for t in ODD] + random + pd.read_parquet(f"{SF}/documents.parquet").text.tolist()[:80]
    pieces, fast = wordpieces.Pieces(wordpieces.vocabulary(name)), wordpieces.Library(wordpieces.vocabulary(name))
    for text, ids in zip(texts, fast.ids_of(texts), strict=True):
        want = np.array(ids_of(library[name], text), "<u4").tobytes()
        assert pieces.ids(text) == want and ids == want


@pytest.mark.parametrize("alphabet", ["ab ,.\n", "aİ ,.×'\"\n\t", "aé1_ ,.-  \n\n", "'stdm,. A÷\r"])
def test_encoders_equal_the_library_on_points_and_commas(library, alphabet):
    rng = np.random.default_rng(len(alphabet))
    texts = [" .", " ,", "İ.", "İ,", "a ,b .c", *("".join(rng.choice(list(alphabet), n)) for n in rng.integers(1, 24, 3000))]
    for name, tokenizer in library.items():
        want = [packed_ids(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        pieces = wordpieces.Pieces(wordpieces.vocabulary(name))
        assert wordpieces.Library(wordpieces.vocabulary(name)).ids_of(texts) == want == list(map(pieces.ids, texts))


def packed_ids(ids):
    return np.array(ids, "<u4").tobytes()


def test_long_cuts_are_not_kept(library):
    fast = wordpieces.Library(wordpieces.vocabulary("byte_bpe_50k.json"))
    assert fast.ids_of(["x" * 100]) == [packed_ids(ids_of(library["byte_bpe_50k.json"], "x" * 100))] and not fast.known.young


def many_words(n):
    """Distinct words of one to three syllables and a few signs, and texts that hold them again and again."""
    syllables = ["".join(x) for x in itertools.product("bdkltmnprs", "aeioué", ["", "n", "r"])]
    words = ["".join(x) for x in itertools.islice(itertools.product(syllables, repeat=3), 0, 37 * n, 37)]
    words = [w + "$" if i % 50 == 0 else w for i, w in enumerate(words)]
    return [" ".join(words[i : i + 500]) for i in range(0, n, 250)]


def calls_of(fast, texts):
    """The ids of texts, and how many calls from Python that took."""
    profile = cProfile.Profile()
    ids = profile.runcall(fast.ids_of, texts)
    return ids, sum(e.callcount for e in profile.getstats())


def test_words_are_not_encoded_one_by_one(library):
    texts = many_words(20_000)
    fast = wordpieces.Library(wordpieces.vocabulary("word_bpe_49k.json"))
    first, calls = calls_of(fast, texts)
    again, calls_again = calls_of(fast, texts)
    assert first == again == [packed_ids(e.ids) for e in library["word_bpe_49k.json"].encode_batch(texts, add_special_tokens=False)]
    assert calls < 20_000 and calls_again < 5_000


def test_words_of_id_files_are_not_encoded_one_by_one(library):
    texts = many_words(20_000)
    fast = wordpieces.Library(wordpieces.vocabulary("byte_bpe_50k.json"), entries=idfiles.CACHE_ENTRIES, chars=idfiles.TOGETHER)
    ids, calls = calls_of(fast, texts)
    assert ids == [packed_ids(e.ids) for e in library["byte_bpe_50k.json"].encode_batch(texts, add_special_tokens=False)]
    assert calls < 20_000 and fast.known.ids.nbytes + fast.known.young.nbytes < 60 * len(fast.known.young)


@pytest.mark.parametrize("entries", [0, 1, 2, 300])
def test_a_full_cache_of_cuts_gives_the_same(library, entries):
    texts = [*many_words(1_000), "x" * 60 + " y " + "z" * 49, "", " \n", "one two, two. three"] * 2
    for name, tokenizer in library.items():
        fast = wordpieces.Library(wordpieces.vocabulary(name), entries=entries, chars=2_000)
        assert fast.ids_of(texts) == [packed_ids(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert len(fast.known.young) <= max(entries, 1) and max(map(len, fast.known.young.to_pylist()), default=0) <= wordpieces.CACHE_CHARS


def test_long_texts_in_stretches(library, monkeypatch):
    monkeypatch.setattr(wordpieces, "BATCH_CHARS", 50)
    text = "Some words, \n\n and  more   words. " * 100
    for name in library:
        fast = wordpieces.Library(wordpieces.vocabulary(name))
        assert fast.ids_of([text, "", text]) == [np.array(ids_of(library[name], t), "<u4").tobytes() for t in (text, "", text)]


def test_long_texts_of_any_blanks_lose_nothing(library, monkeypatch):
    monkeypatch.setattr(wordpieces, "BATCH_CHARS", 10)
    texts = ["12\n34\n56\n78\n90\n" * 8, "a1\n\n\n  two \t\n\tx.\n" * 20, "https://a.b/c?d=1\r\n" * 20, " " * 90 + "x", "x" * 90 + " \n" * 40, "x" * 90]
    assert all("".join(wordpieces.stretches(t)) == t for t in texts) and len(wordpieces.stretches(texts[0])) > 5
    for name in library:
        fast = wordpieces.Library(wordpieces.vocabulary(name))
        assert fast.ids_of(texts) == [np.array(ids_of(library[name], t), "<u4").tobytes() for t in texts]


def test_bpe_query_and_odd_documents(spark, library):
    tokenizer = library["word_bpe_49k.json"]
    for r in wordpieces.encode_decode(odd_docs(spark), wordpieces.vocabulary("word_bpe_49k.json")).collect():
        text = ODD[r.id] if r.id is not None else ODD[3]
        assert r.token_ids == ids_of(tokenizer, text) and r.decoded == tokenizer.decode(r.token_ids, skip_special_tokens=False)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in wordpieces.op4_bpe(spark, SF).collect():
        ids = ids_of(tokenizer, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing_covers_every_id_once(spark, library):
    assert packing.binary_lengths(2048 * 2 + 13) == [2048, 2048, 8, 4, 1]
    path = wordpieces.vocabulary("word_bpe_49k.json")
    for docs, text_of in ((odd_docs(spark), lambda i: ODD[3 if i is None else i]), (spark.read.parquet(f"{SF}/documents.parquet"), dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()).get)):
        pieces = packing.pack(docs, path).collect()
        assert len({r.sequence_id for r in pieces}) == len(pieces)
        assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 and len(r.ids) == 4 * r.length for r in pieces)
        copies = Counter(r.doc_id for r in docs.select("doc_id").collect())
        for doc, own in itertools.groupby(sorted(pieces, key=lambda r: (r.id is None, r.id or 0, r.start)), key=lambda r: r.id):
            own = list(own)
            want = [*ids_of(library["word_bpe_49k.json"], text_of(doc)), 1]
            joined = np.frombuffer(b"".join(bytes(r.ids) for r in own[:: copies[doc]]), "<u4").tolist()
            assert joined == want and {r.doc_tokens for r in own} == {len(want)}
    assert packing.pack(empty(spark), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty(spark), path, window=1000)


def test_rank_coding_round_trip():
    rng = np.random.default_rng(5)
    for sizes in ([0], [1], [3], [4, 0, 5], [1000, 1, 0, 7, 0], []):
        sizes = np.array(sizes, np.int64)
        ranks = (rng.integers(0, 1 << 32, sizes.sum(), dtype=np.uint64) >> rng.integers(0, 32, sizes.sum()).astype(np.uint64)).astype(np.uint32)
        control, data = idfiles.encode_many(ranks, sizes)
        assert [len(c) for c in control] == (-(-sizes // 4)).tolist() and (idfiles.decode_many(b"".join(control), b"".join(data), sizes) == ranks).all()
        at = 0
        for c, d, n in zip(control, data, sizes.tolist(), strict=True):  # each record can be read by itself
            assert (idfiles.decode_many(c, d, np.array([n])) == ranks[at : at + n]).all()
            at += n


def test_id_files_round_trip(spark, library):
    tokenizer, path = library["byte_bpe_50k.json"], wordpieces.vocabulary("byte_bpe_50k.json")
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    at = 0
    for r in sorted(idfiles.op7_ids(spark, SF).collect(), key=lambda r: r.doc_id):
        ids = np.array([*ids_of(tokenizer, texts[r.doc_id]), 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    out = fresh_path(spark, "test-ids")
    idfiles.write_ids(odd_docs(spark), path, out)
    got = idfiles.read_ids(spark, out).collect()
    assert Counter((r.id, bytes(r.ids)) for r in got) == Counter((r.doc_id, np.array([*ids_of(tokenizer, r.text), 2], "<u4").tobytes()) for r in odd_docs(spark).collect())
    got.sort(key=lambda r: r.start)
    assert [r.id for r in got] == sorted([r.id for r in got], key=lambda i: (i is not None, i or 0))
    assert all(b.start == a.start + len(a.ids) // 4 for a, b in itertools.pairwise(got))
    out = fresh_path(spark, "test-none")
    idfiles.write_ids(empty(spark), path, out)
    assert idfiles.read_ids(spark, out).count() == 0


def brute_lines(rows, least=10, documents=2):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: (i is None, i or 0)
    holders: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if not (len(key(x)) >= least and len(holders[key(x)]) >= documents and min(holders[key(x)], key=order) != i)]
        out.append((i, (t or "").count("\n") + 1, "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("documents", [2, 3])
def test_line_dedup(spark, documents):
    texts = ["Hello there world\nb\nHELLO there World  ", "x\n\thello there world", None, "", "éééééééééé\nhello there world", "ÉÉÉÉÉÉÉÉÉÉ\néééééééééé\nééééééééé", "hello there world"]
    rows = [(i if i != 6 else None, t) for i, t in enumerate(texts)] + [(1, texts[1]), (7, "hello there world\n\n")]
    docs = spark.createDataFrame([(i, t, "k", b"d", 1) for i, t in rows], "doc_id long, text string, cf_id string, cf_drops binary, drops long")
    got = lines.dedup_lines(docs, documents=documents)
    assert got.columns == [*docs.columns, "cf_lines", "cf_dropped"]
    assert Counter((r.doc_id, r.cf_lines, r.text or "") for r in got.collect()) == brute_lines(rows, documents=documents)
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_of_rows_without_ids(spark):
    shared = "a line that all of them have"
    rows = [(None, f"{shared}\none"), (None, f"{shared}\ntwo"), (None, f"{shared}\none")]
    got = Counter(r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got in (Counter([f"{shared}\none", f"{shared}\none", "two"]), Counter(["one", "one", f"{shared}\ntwo"]))
    named = lines.dedup_lines(spark.createDataFrame([*rows, (5, shared)], "doc_id long, text string"))
    assert Counter(r.text for r in named.collect()) == Counter(["one", "two", "one", shared])
    three = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), documents=3)
    assert Counter(r.text for r in three.collect()) == Counter(t for _, t in rows)


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if wins[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    worded = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), len(hit)


def test_quality_ledger(spark):
    texts = [*ODD, "a b c d e f a b c d e g h i j k l m n o p", "x\ny\nx\n x\n\n\n", "## || <b> *"]
    got = {r.id: r for r in quality.verdicts(quality.ledger(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want, r = brute_quality(t), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)
    assert quality.ledger(odd_docs(spark)).count() == len(ODD) + 2 and quality.ledger(empty(spark)).count() == 0


def test_quality_ablations(spark):
    entries = quality.stored_ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    bits = [r.fail_bits for r in entries.collect()]
    for r in quality.ablations(entries).collect():
        bit = quality.mask([r.rule])
        assert r.failing == sum(b & bit > 0 for b in bits) and r.only == sum(b == bit for b in bits)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    found = language.identify(docs, model).toPandas().merge(docs.select("doc_id", "lang", "text").toPandas(), left_on="id", right_on="doc_id")
    held = found[[zlib.crc32(str(i).encode()) % 4 == 2 for i in found.id]]
    assert len(held) > 200 and (held.lang_pred == held.lang).mean() > 0.98
    assert held.score.between(0, 1).all() and held.sure.mean() > 0.97
    odd = {r.id: (r.lang_pred, r.score) for r in language.identify(docs_of(spark, ["", None, "12 !? 3", "the ering"]), model).collect()}
    assert {odd[i] for i in range(3)} == {("und", 0.0)} and odd[3][0] == "en"
    assert {r.lang_pred for r in language.identify(odd_docs(spark), language.fit(empty(spark))).collect()} == {"und"}
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == found.sure.sum()


def test_language_learns_every_label_and_rejects_what_it_never_saw(spark):
    rng = np.random.default_rng(5)
    alphabets = ["".join(chr(0x4E00 + 40 * k + j) for j in range(12)) for k in range(140)]
    text = lambda k: " ".join("".join(rng.choice(list(alphabets[k]), 4)) for _ in range(12))
    rows = [(i, text(i % 140), f"l{i % 140:03d}") for i in range(140 * 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.languages) == 140 and model.layer is not None
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([model.predict(t)[0] == x for _, t, x in held]) > 0.9
    few = language.fit(docs.where("lang < 'l002'"))
    sure = lambda ts: np.mean([few.predict(t)[2] for t in ts])
    assert few.layer is None and sure([t for _, t, x in rows if x < "l002"]) > 0.9 and sure([t for _, t, x in rows if x > "l100"]) == 0
    long = language.fit(spark.createDataFrame([(i, "ab " * 70_000, "x") for i in range(8)] + [(i, "cd", "y") for i in range(8, 16)], "doc_id long, text string, lang string"))
    assert long.predict("ab ab ab")[0] == "x" and long.predict("cd")[0] == "y"


def brute_components(texts, ids):
    sets = [frozenset(shingle_set(t or "").tolist()) for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[root(j)] = root(i)
    least: dict = {}
    for i in range(len(sets)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[root(i)]) for i in range(len(sets))}


def near_texts():
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(3000)]
    passage = list(rng.choice(vocab, 60))
    texts: list = ["", None, "a", "A", "a b c d", "A B c D", "a b c d e", " \n"]
    for size in (12, 30, 80, 200, 700):
        base = list(rng.choice(vocab, size))
        for k in range(14):
            copy = base.copy()
            for at in rng.integers(0, size, int(size * rng.choice([0, 0.01, 0.02, 0.03, 0.05]))):
                copy[at] = "z" + str(rng.integers(10**6))
            texts.append(" ".join(copy))
            texts.append(" ".join([*rng.choice(vocab, k), *passage, *rng.choice(vocab, 3)]))
    return texts


@pytest.mark.parametrize(("least", "part"), [(64, 512), (2, 3)])
def test_ngram_join_is_exact(spark, monkeypatch, least, part):
    monkeypatch.setattr(ngram_join, "FREQUENT", least)  # 2: nearly all shared tokens are frequent and combined
    monkeypatch.setattr(ngram_join, "KEY_PART", part)
    monkeypatch.setattr(ngram_join, "HOT_PART", part)  # 3: shared keys are dealt in parts from the first sort on
    texts = near_texts()
    order = np.random.default_rng(2).permutation(len(texts)).tolist()
    docs = spark.createDataFrame([(i, texts[i], "a", "b") for i in order], "doc_id long, text string, cf_set string, content string")
    got = {r.id: (r.n, r.component_id) for r in ngram_join.components(docs).collect()}
    assert got == brute_components(texts, list(range(len(texts))))
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (n, c) in got.items() if i == c}


def test_ngram_join_on_the_tables_and_odd_rows(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op10_ngram_join(spark, SF).collect()}
    assert got == brute_components([r.text for r in rows], [r.doc_id for r in rows])
    assert ngram_join.components(empty(spark)).count() == 0 and ngram_join.keep_first(empty(spark)).count() == 0
    assert ngram_join.components(odd_docs(spark)).count() == len(ODD) + 2
    assert ngram_join.keep_first(odd_docs(spark)).count() == len(ODD)


def test_prefix_keys_meet_for_every_similar_pair():
    rng = np.random.default_rng(4)
    for n in (1, 2, 4, 5, 9, 20, 60, 150, 400):
        for _ in range(25):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            swap = rng.integers(0, max(1, int(n * 0.11)) + 1)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[swap:]], rng.integers(0, 1 << 63, swap, dtype=np.uint64)]))
            levels, frequent = rng.integers(0, 90, 1 << 18, dtype=np.uint8), int(rng.choice([0, 9, 45, 90]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                (ka, ra, pa), (kb, rb, pb) = ngram_join.index_keys(a, levels, frequent), ngram_join.index_keys(b, levels, frequent)
                _, ia, ib = np.intersect1d(ka, kb, return_indices=True)
                assert len(ia) and (np.minimum(ra[ia], rb[ib]) >= both).any() and (pa[ia] == pb[ib]).all()
                assert ngram_join.may_be_similar(ngram_join.parity(a), ngram_join.parity(b), len(a), len(b))


def test_parities_rule_out_only_what_is_not_similar():
    rng = np.random.default_rng(14)
    ruled_out = 0
    for n in (1, 3, 30, 64, 65, 300, 3000):
        for share in (0, 0.4, 0.7, 0.79, 0.8, 0.82, 1):
            for _ in range(6):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                swap = round(len(a) * (1 - share) / (1 + share))
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[swap:]], rng.integers(0, 1 << 63, swap, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                passed = ngram_join.may_be_similar(ngram_join.parity(a), ngram_join.parity(b), len(a), len(b))
                assert passed or 100 * both < 80 * (len(a) + len(b) - both)
                ruled_out += not passed
    assert ruled_out > 80


def test_keep_first_of_equal_ids_sets_and_texts(spark):
    rows = [(1, "a b c d e f", "z"), (1, "A b c d e f", "y"), (1, "a b c d e f", "x"), (2, "a b c d e f", "w"), (None, "q r s t u", "v"), (None, "q r s t u", "u"), (3, None, "t"), (3, "", "s")]
    kept = [ngram_join.keep_first(spark.createDataFrame(order, "doc_id long, text string, tail string")).collect() for order in (rows, rows[::-1])]
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1])) and Counter(r.doc_id for r in kept[0]) == {1: 1, None: 1, 3: 2}


def test_joins_by_hot_keys(spark, monkeypatch):
    from chronofold.llm import common

    monkeypatch.setattr(common, "KEY_ROWS", 3)
    rows = [(k, i) for i, k in enumerate("a" * 9 + "bbb" + "c" + "dddd")] + [(None, 99), ("z", 98)]
    table = [(k, n, v) for k, n, v in (("a", 9, 1), ("b", 3, None), ("c", 1, 3), ("d", 4, 4))]
    got = common.join_by_key(spark.createDataFrame(rows, "k string, i int"), spark.createDataFrame(table, "k string, w long, v int"), "k", "w", len(rows))
    assert got.columns == ["k", "i", "v"] and {tuple(r) for r in got.collect()} == {(k, i, v) for k, i in rows for x, _, v in table if k == x}


def test_connected(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(x):
    good = [i for i, v in enumerate(x) if v is not None and len(v) and all(c is not None for c in v) and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(x[i], float) / np.linalg.norm(x[i]) for i in good}
    return {(i, j) for i, j in itertools.combinations(good, 2) if len(x[i]) == len(x[j]) and float(unit[i] @ unit[j]) >= 0.9}


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 64))
    x = [v.tolist() for v in base]
    for k in range(240):
        v = base[k % 40] / np.linalg.norm(base[k % 40])
        x.append((v + rng.normal(size=64) * rng.choice([0.0, 0.02, 0.04, 0.055])).tolist())
    hot = rng.normal(size=64)
    x += [(hot + rng.normal(size=64) * 0.05).tolist() for _ in range(300)]
    x += [None, [], [0.0] * 64, [None] * 64, [float("nan")] * 64, [1.0, 2.0], [2.0, 4.0], x[0], x[0]]
    table = spark.createDataFrame([(i, v, "n") for i, v in enumerate(x)], "vec_id long, embedding array<double>, name string")
    got = {r.id: r for r in neighbours.near_duplicates(table).collect()}
    pairs = brute_vectors(x)
    want = Counter(itertools.chain.from_iterable(pairs))
    assert len(got) == len(x) and all(got[i].n_links <= want[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.95 * 2 * len(pairs)
    for i, j in pairs:
        if got[i].n_links == want[i] and got[j].n_links == want[j]:
            assert got[i].component_id == got[j].component_id
    assert all(r.kept == (r.id == r.component_id) for r in got.values()) and got[len(x) - 1].component_id == 0
    assert neighbours.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("n", [300, 51_282, 10**6])
def test_recall_at_the_least_cosine(n):
    z, size = neighbours.bound_and_codes(n)
    caps = neighbours.Caps(64, z, size, neighbours.sets_needed(64, z, size))
    rng = np.random.default_rng(77)
    x, y = rng.normal(size=(2, 300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(caps.decode(x), caps.decode(y), strict=True)]) >= 0.93


def test_recall_holds_for_a_table_of_100_million_vectors():
    z, size, sets = neighbours.filters_needed(10**8, 64)
    assert neighbours.sets_needed(64, z, size) == sets <= neighbours.MOST_SETS
    z, size, sets = neighbours.filters_needed(117_187_500, 64)  # 30 GB of 64 floats each; 40 sets of caps for 8 miss the recall
    assert neighbours.sets_needed(64, z, size) == sets <= neighbours.MOST_SETS
    caps, missed = neighbours.Caps(64, z, size, sets), np.ones(400, bool)
    rng = np.random.default_rng(78)
    x, y = rng.normal(size=(2, 400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for i in range(sets):
        missed[missed] = [not len(np.intersect1d(a, b)) for a, b in zip(caps.of_set(x[missed], i), caps.of_set(y[missed], i), strict=True)]
    assert 1 - missed.mean() >= 0.96


def test_a_recall_out_of_reach_is_an_error(monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_SETS", 1)
    with pytest.raises(ValueError):
        neighbours.filters_needed(300, 64)


@pytest.mark.parametrize("dimensions", [(8,), (16,), (32,), (3, 128)])
def test_links_of_other_dimensions(spark, monkeypatch, dimensions):
    monkeypatch.setattr(neighbours, "PART", 100)  # so that some dimensions have filters and the rarest has none
    rng, x = np.random.default_rng(12), []
    for d in dimensions:
        for v in rng.normal(size=(40, d)):
            x += [(v / np.linalg.norm(v) + rng.normal(size=d) * s / np.sqrt(d)).tolist() for s in (0, 0.2, 0.3, 0.4, 0.45)]
    x += [[1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 2.0, 3.0, 4.0, 5.1], [-1.0, 2.0, 3.0, 4.0, 5.0]]
    table = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = {r.id: r for r in neighbours.near_duplicates(table).collect()}
    want = Counter(itertools.chain.from_iterable(brute_vectors(x)))
    assert all(got[i].n_links <= want[i] for i in got) and sum(r.n_links for r in got.values()) >= 0.95 * sum(want.values())
    n = len(x)
    assert [got[i].n_links for i in (n - 3, n - 2, n - 1)] == [want[i] for i in (n - 3, n - 2, n - 1)]


def test_neighbours_query_equals_brute_force(spark, tmp_path):
    """The query on a table that has links; the supplied one has hardly any."""
    rng = np.random.default_rng(15)
    base = rng.normal(size=(60, 64)).astype("f4")
    x = [(base[i % 60] + rng.normal(size=64).astype("f4") * rng.choice([0, 0.2, 0.4])).astype("f4").tolist() for i in range(300)]
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.op5_neighbours(spark, str(tmp_path)).collect()}
    pairs = brute_vectors(x)
    want = Counter(itertools.chain.from_iterable(pairs))
    groups = dict(connected(spark.createDataFrame(sorted(pairs), "a long, b long")).collect())
    assert len(pairs) > 300 and sum(n for n, _, _ in got.values()) >= 0.95 * 2 * len(pairs)
    same = [i for i in got if got[i] == (want[i], groups.get(i, i), groups.get(i, i) == i)]
    assert len(same) >= 0.93 * len(got)


def test_parts_of_hot_caps_count_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = [(np.ones(16) + rng.normal(size=16) * 0.02).tolist() for _ in range(90)]
    table = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "PART", 10)
    assert {(r.n_links, r.component_id) for r in neighbours.near_duplicates(table).collect()} == {(89, 0)}
