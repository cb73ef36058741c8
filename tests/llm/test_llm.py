"""Operators of the llm subpackage against plain versions on small tables."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harvestlake.llm import common, decontam, jaccard, kernels, ledger, mixing, pagediff, queries, quotes, repeats, tokens, toxicity, warc
from harvestlake.session import fresh_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t) if t else 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = [None, "", " \n ", "one", "two words"]
    for _ in range(12):
        base = sentence(rng, 60)
        out += [base, base, base + " tail", "lead " + base, base.replace(base.split()[30], "other", 1)]
    shared = sentence(rng, 70)
    out += [sentence(rng, 20) + " " + shared + " " + sentence(rng, 20) for _ in range(4)]
    return out + [sentence(rng, 3000, 50), "é" * 900 + "漢" * 300]


def words(t, fold=False):
    import re

    t = t or ""
    if fold:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_substring_hashes_are_of_the_bytes():
    a = np.frombuffer(b"abcabcabd", np.uint8)
    h = kernels.Substrings(a)
    assert h(np.array([0]), np.array([3])) == h(np.array([3]), np.array([6])) != h(np.array([6]), np.array([9]))
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 60, 57).astype(np.uint64)
    assert kernels.sliding_min(v, 5).tolist() == [min(v[i : i + 5]) for i in range(53)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 230)] + [(229, 100)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: 7 for p in links for n in p}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 5: quality rules


def brute_repeats(w):
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    return len({j for s in at.values() if len(s) > 1 for i in s for j in range(i, i + 8)})


def test_ledger_measures(spark, texts):
    texts = [*texts, "a b\na b\n\n\t\n# x", "x y z w v u t s " * 5, "AA BB " * 30, "NaN"]
    rows = {r.doc_id: r for r in ledger.ledger(docs_of(spark, texts).withColumn("n_words", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), brute_repeats(w))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")


def test_policies_and_ablation_read_the_bits(spark, texts):
    book = ledger.ledger(docs_of(spark, texts))
    names = [n for n, _ in ledger.RULES]
    got = {r.rule: (r.n_failed, r.n_only) for r in ledger.ablation(book).collect()}
    bits = [r.failures for r in book.collect()]
    for k, n in enumerate(names):
        assert got[n] == (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits))
    kept = {r.doc_id for r in ledger.reject(docs_of(spark, texts)).collect()}
    assert kept == {r.doc_id for r in book.where(~ledger.fails("v1")).collect()}
    assert ledger.ledger(docs_of(spark, [])).count() == 0


# 2: archive


def test_archive_round_trip(spark):
    html = ["<p>a</p>", "<p>b</p>\r\n\r\nx", "<p>a</p>", None, "", "ü" * 50, "<p>a</p>"]
    rows = [(i + 10, None if i == 1 else f"http://h/{i}", h, "x") for i, h in enumerate(html)] + [(10, "http://h/0", "<p>a</p>", "x"), (None, "http://h/n", "<p>a</p>", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, address string")
    folder = fresh_path(spark, "warc")
    warc.write_archive(pages, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    got = warc.read_archive(spark, folder).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    body = {i: h or "" for i, _, h, _ in rows}
    for r in got:
        raw = body[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        lead = first[body[r.page_id]]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == lead else ("revisit", lead))
    for r in warc.records(spark, folder).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(head.rpartition(b"Content-Length: ")[2])
        assert rest[size:] == b"\r\n\r\n" and (r.record_type == "revisit" or rest[:size].endswith(bytes(r.payload)))
    assert [r.record_type for r in warc.plan_records(pages, min_bytes=10**6).collect()] == ["response"] * len(rows)


# 3: page text


def test_page_markup():
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><div class="cookie notice">c</div>
    <nav><a>m</a></nav><article><h1>A &amp;amp; B&#x41;</h1><p>one <b>two</b>\n three<p>four<br>five</p><form>f</form>
    <section id="comments"><p>reader</p></section></article><aside>s</aside><footer>x</footer>"""
    assert [x for x, s in pagediff.page_lines(page) if s == pagediff.TEXT] == ["A &amp; BA", "one two three", "four", "five"]
    assert pagediff.page_lines(None) == [] and pagediff.page_lines("a < b") == [("a < b", pagediff.OPEN)]


def test_common_lines_are_longest():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pagediff.common_lines(a, b)) == best[-1][-1]


def test_differencing_deletes_what_neighbours_share(spark):
    rows = [(i, f"http://h/p/{i:02d}?q={i}", f"<div>site line</div><p>page {i}</p><div>terms</div>") for i in range(9)]
    rows += [(20, "http://alone/x", "<p>kept</p>"), (21, None, "<p>no url</p>"), (22, "http://h/p/03", None), (23, "http://h/p/04", "<article>same</article>")]
    got = {r.page_id: (r.text, r.n_chars) for r in pagediff.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(9)] == [(f"page {i}", 6) for i in range(9)]
    assert (got[20], got[21], got[22], got[23]) == (("kept", 4), ("no url", 6), ("", 0), ("same", 4))


# 4: token counts


def test_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = tokens.piece_vocabulary(queries.VOCABULARY)
    plain = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    plain.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.SPACE, prepend_scheme="always", split=True)
    rng = random.Random(5)
    made = ["".join(rng.choice("aab \n▁é漢😀<0x41>s  eth") for _ in range(rng.randrange(40))) for _ in range(500)]
    made += ["the " * 3000, "x" * 5000]
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs_of(spark, [*made, None]), queries.VOCABULARY).collect()}
    assert [got[i] for i in range(len(made) + 1)] == [len(plain.encode(t).ids) for t in made] + [0]


# 6: quotations


def test_replies_follow_quotes(spark):
    rows = [
        (1, 0, "u", "Hello  there\nhow are you"), (1, 1, "a", "fine"), (1, 2, "u", "> hello there\n> HOW are you\nstill asking"),
        (1, 3, "a", "> nothing like it\nwhat"), (1, 4, "u", ">> hello there\n> fine\nok"), (1, 5, "a", "> how are you"), (2, 0, "u", None), (2, 0, "u", None), (None, 7, "u", "> fine"),
    ]
    got = {(r.conv_id, r.position): r for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert len(got) == len(rows)
    assert [got[1, i].reply_to for i in range(6)] == [None, 0, 0, 2, 1, 0]
    assert [got[1, i].text for i in range(6)] == ["Hello  there\nhow are you", "fine", "still asking", "what", "ok", ""]
    assert [(got[1, i].n_quoted, got[1, i].n_linked) for i in (2, 3, 4)] == [(1, 1), (1, 0), (2, 2)]
    assert got[2, 1].turn == 0 and got[None, 0].n_linked == 0


def test_mail_keeps_every_message(spark, tmp_path):
    import duckdb

    rows = [(c, t, "ua"[t % 2], f"conversation {c} turn {t}") for c in (1, 2, None) for t in range(5)]
    rows += [(1, t, "x", f"second message of {t}") for t in (0, 2, 3)] + [(2, 3, "a", "conversation 2 turn 3")] * 2 + [(None, 0, "u", "conversation None turn 0")]
    rows += [(3, None, "u", "no turn"), (3, None, "u", "no turn"), (3, None, "a", "none either"), (3, 0, "u", "start"), (3, 1, "a", "next")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    df = queries.QUERIES["op6_quotation_links"](spark, str(tmp_path))
    got = [r.asDict() for r in df.collect()]
    assert sorted(map(str, ((r["conv_id"], r["turn"], r["role"], r["text"]) for r in got))) == sorted(map(str, rows))
    for r in got:
        if r["turn"] is None:
            assert (r["reply_to"], r["n_quoted"], r["n_linked"]) == (None, 0, 0) and r["position"] < 3
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cur = con.execute(queries.ORACLES["op6_quotation_links"])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    # messages of one turn have no order among themselves, and the SQL numbers null turns last and gives them quotes
    for cols in (["conv_id", "turn", "role", "text", "reply_to", "n_quoted", "n_linked"], ["conv_id", "turn", "position"]):
        a, b = (sorted(str([r[c] for c in cols]) for r in x if r["turn"] is not None and (r["conv_id"] != 3 or "position" not in cols)) for x in (got, want))
        assert a == b


# 7: repeats


def test_repeats_equal_brute_force(spark, texts):
    length = 40
    rng = random.Random(11)
    more = ["ab" * 100, "x" * 41, "y" * 39, "".join(rng.choice("ab") for _ in range(600))]
    texts = [*texts, *more]
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    got = {r.doc_id: tuple(r)[1:] for r in repeats.report_repeats(docs_of(spark, texts), length).collect()}
    left = {}
    for d, b in enumerate(raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        assert got[d] == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()), d
        if kept or not sum(gone):
            left[d] = kept.decode("utf-8", "ignore") if sum(gone) else texts[d]
    kept_rows = {r.doc_id: r for r in repeats.remove_repeats(docs_of(spark, texts), length, n_chars="n_chars").collect()}
    assert {d: r.text for d, r in kept_rows.items()} == {d: t for d, t in left.items() if t != "" or not raw[d]}


def test_long_texts_are_cut_into_parts(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = repeats.borders(data, 60)
    monkeypatch.setattr(repeats, "PART", 700)
    parts = repeats.borders(data, 60)
    assert set(whole[0]) == set(parts[0])


# 8: toxicity


def test_toxic_held_out_rows(spark):
    rng = random.Random(4)
    texts, toxic = [], []
    for k in range(600):
        t, bad = sentence(rng, 30).split(), k % 5 == 0
        if bad:
            t[rng.randrange(30)] = rng.choice(["gronk", "blubber" + rng.choice("abcdefgh")])
        texts.append(" ".join(t))
        toxic.append(int(bad))
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(toxic)] + [(None, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels)
    rows = toxicity.score(docs.unionByName(docs_of(spark, [None, ""])), model).collect()
    assert all(r.predicted == toxic[r.doc_id] for r in rows if r.doc_id > 1)
    assert any(r.held_out for r in rows) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.learn(docs, labels.limit(0)).words == frozenset()


def test_clause_patterns():
    m = toxicity.Model(frozenset({"fool"}))
    assert toxicity.clause_pattern("you are not a fool", m) == (1, False, True, True, False)
    assert toxicity.clause_pattern("she said fool", m) == (1, False, False, False, True)
    assert toxicity.clause_pattern("i will hurt you", m) == (0, True, True, False, False)
    assert toxicity.clause_pattern("hello you", m) is None


def test_composed_grammar_equals_its_transducers(spark):
    """The one automaton ends where the five, run one after the other, end: on all short clauses and many long ones."""
    import itertools

    line = (toxicity.negation_transducer(), toxicity.speech_transducer(), toxicity.target_transducer(), toxicity.threat_transducer(), toxicity.insult_transducer())
    rng = random.Random(14)
    clauses = [list(c) for k in range(5) for c in itertools.product(toxicity.SYMBOLS, repeat=k)] + [rng.choices(toxicity.SYMBOLS, k=rng.randrange(5, 30)) for _ in range(2000)]
    for clause in clauses:
        symbols, ends = clause, []
        for t in line:
            end, symbols = t.run(symbols)
            ends.append(end)
        state, out = toxicity.GRAMMAR.run(clause)
        assert state == ((((ends[0], ends[1]), ends[2]), ends[3]), ends[4]) and out == symbols
        # and what it means, read off the clause
        marks, reach, speech = [], 0, False
        for x in clause:
            if x in "IT":
                marks.append((x, reach > 0, speech))
            speech |= x in "RQ"
            reach = 3 if x == "N" else reach if x == "Q" else max(0, reach - 1)
        insults = min(3, sum(x == "I" for x, _, _ in marks))
        want = (insults, any(x == "T" for x, _, _ in marks), "G" in clause, any(n for _, n, _ in marks), any(r for _, _, r in marks)) if marks else None
        assert toxicity.pattern_of(state) == want


def test_scores_equal_plain_reading(spark):
    model = toxicity.Model(frozenset({"fool"}), frozenset({"grum"}), {(1, False, False, False, False): 0.9, (0, True, True, False, False): 0.8}, {1: 0.5, 2: 0.7}, 0.1)
    texts = {"you fool. nice day": 1 - 0.9 * 0.5, "fool": 1 - 0.9 * 0.1, "Grumbling, fool fool": 1 - 0.9 * 0.1 * 0.3, "I will kill you": 1 - 0.9 * 0.2, "foolish": 0.1, "": 0.1, "x " * 50_000 + "fool": 1 - 0.9 * 0.1}
    docs = docs_of(spark, [*texts, None]).withColumn("score", F.lit("clash")).withColumn("family", F.lit(1)).withColumn("toxic", F.lit(1))
    rows = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(abs(rows[i] - s) < 1e-9 for i, s in enumerate([*texts.values(), 0.1]))
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_near_copies_teach_once(spark):
    """The words of a toxic text with many copies are no insults; an insult of many texts is."""
    rng = random.Random(15)
    base = sentence(rng, 60, 50) + " gleb zorf quam"
    texts = [f"{base} v{k}" for k in range(40)] + [sentence(rng, 25) + " blarg " + sentence(rng, 5) for _ in range(60)] + [sentence(rng, 30) for _ in range(500)]
    toxic = [1] * 100 + [0] * 500
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")
    model = toxicity.learn(docs_of(spark, texts), labels)
    assert toxicity.is_insult("blarg", model) and not any(toxicity.is_insult(w, model) for w in ("gleb", "zorf", "quam"))


# 9: leaks


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.randrange(8, 60), 3000) + ".\n" + sentence(rng, 6, 3000)) for i in range(90)] + [(500, None), (501, ""), (502, "word")]
    texts = [None, "", "word"]
    for k in range(60):
        t = sentence(rng, rng.randrange(5, 400), 3000)
        texts.append(t + " " + items[k][1].upper() + " " + t if k % 3 == 0 else t)
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    grams = {i: {tuple(words(t, True)[k : k + 5]) for k in range(max(1, len(words(t, True)) - 4))} for i, t in items if words(t)}
    for limit in (2_000_000, 700):
        got = {r.doc_id: [x.item_id for x in r._leaks] for r in decontam.find_leaks(docs_of(spark, texts), frame, max_index_rows=limit).collect()}
        for d, t in enumerate(texts):
            w = words(t, True)
            own = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            assert sorted(got[d]) == [i for i, g in grams.items() if len(g & own) >= 0.8 * len(g)], d
    assert decontam.decontaminate(docs_of(spark, texts), frame).columns == [c.split()[0] for c in DOCS.split(", ")]
    assert decontam.find_leaks(docs_of(spark, texts), frame.limit(0)).where("size(_leaks) > 0").count() == 0


def test_leaks_of_short_parts(spark):
    rng = random.Random(10)
    items = [(i, sentence(rng, 14, 3000) + ".\n" + " ".join(f"answer{i}x{k}" for k in range(1 + i % 4))) for i in range(8)]
    items += [(10 + i, " ".join(f"title{i}x{k}" for k in range(1 + i))) for i in range(4)]
    items += [(20 + i, " ".join(f"ask{i}x{k}" for k in range(1 + i)) + ".\n" + sentence(rng, 20, 3000)) for i in range(4)]

    def grams(w, width):
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}

    def share(part, w):
        width = min(5, len(part))
        own = grams(part, width)
        return len(own & grams(w, width)) / len(own) if own else 1.0

    lead, want, texts = sentence(rng, 200, 3000), [], []
    for i, t in items:
        parts = [words(x, True) for x in (t, *decontam.question_and_answer(t))]
        for at in (None, 0, len(t.split()) // 2, len(t.split()) - 1):
            made = [x if k != at else "other" for k, x in enumerate(t.split())]
            texts.append(f"{lead} {' '.join(made).upper()} {lead}")
            whole, question, answer = (share(p, words(texts[-1], True)) for p in parts)
            want.append([i] if whole >= 0.8 or (whole > 0 and question >= 0.5 and answer >= 0.5) else [])
    assert all(want[0::4]) and [] in want[1::4] and all(want[2:32:4])
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: [x.item_id for x in r._leaks] for r in decontam.find_leaks(docs_of(spark, texts), frame).collect()}
    assert [got[d] for d in range(len(texts))] == want


# 10: shingle join


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = words(t, True)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, texts, width, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(docs_of(spark, texts), width, percent).collect()}
    want = brute_components(texts, width, percent)
    assert [got[i] for i in range(len(texts))] == want
    kept = sorted(r.doc_id for r in jaccard.keep_one(docs_of(spark, texts), width, percent).collect())
    assert kept == [i for i, (n, c) in enumerate(want) if n == 0 or c == i]


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_link_counts_equal_brute_force(spark, texts, width, percent):
    sets = []
    for t in texts:
        w = words(t, True)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    want = [sum(1 for j, y in enumerate(sets) if i != j and x and 100 * len(x & y) >= percent * len(x | y)) for i, x in enumerate(sets)]
    got = {r.doc_id: (r.n_shingles, r.n_links) for r in jaccard.count_links(docs_of(spark, texts), width, percent).collect()}
    assert [got[i] for i in range(len(texts))] == [(len(x), n) for x, n in zip(sets, want, strict=True)]


def test_bounds_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for size in (1, 7, 300):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[size // 3 :], rng.integers(0, 1 << 63, size // 3 + 1).astype(np.uint64)]))
        differ = len(np.setxor1d(a, b))
        assert sum(int(x).bit_count() for x in (jaccard.parity(a) ^ jaccard.parity(b)).view(np.uint64)) <= differ
        assert jaccard.difference_bound(jaccard.signature(a), jaccard.signature(b)) <= differ


def test_counts_survive_packing(spark, texts):
    for top in (0, 255, 256, 1 << 33):
        block = np.zeros(jaccard.BLOCK, np.int64)
        block[3] = top
        assert (jaccard.unpack_counts(jaccard.pack_counts(block)) == block).all()
    got = np.frombuffer(jaccard.shingle_levels(docs_of(spark, texts).repartition(5), 3), np.uint8)
    want = np.zeros(1 << 21, np.int64)
    for t in texts:
        np.add.at(want, (jaccard._raw_shingles(t, 3) >> np.uint64(43)).astype(np.int64), 1)
    assert (got == np.log2(want + 1).astype(np.uint8)).all()


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert jaccard.join_components(none).count() == repeats.report_repeats(none).count() == 0
    assert pagediff.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# 1: mixing


def test_rates_meet_targets(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("alpha", "beta") if k % 3 else ("gamma", "delta")) for _ in range(20)) for k in range(300)]
    labels = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(0, 300, 2)], "doc_id bigint, domain string")
    rows = mixing.mix(docs_of(spark, [*texts, None]), labels, {"x": 0.4, "y": 0.6}).collect()
    total = sum(r.n_tokens for r in rows)
    for d, goal in (("x", 0.4), ("y", 0.6)):
        assert abs(sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in rows) / total - goal) < 1e-3
    assert len(rows) == 301 and min(r.rate for r in rows) >= 0
    # a plain projected gradient descent over documents finds the same totals
    p, n = np.array([[r.p_x, r.p_y] for r in rows]), np.array([r.n_tokens for r in rows], float)
    rate, goal = np.ones(len(rows)), np.array([0.4, 0.6]) * total
    for _ in range(200):
        rate = np.maximum(0, rate - p @ (((n * rate) @ p - goal) / (n @ p)))
    assert np.allclose(rate[n > 0], [r.rate for r in rows if r.n_tokens], atol=1e-2)


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    item = sentence(rng, 30, 5000)
    passage = sentence(rng, 90, 5000)
    clean = [sentence(rng, 80, 5000) for _ in range(30)]
    texts = [*clean, clean[0], clean[1] + " more", "few words", "### " * 60, sentence(rng, 40, 5000) + " " + item]
    texts += [sentence(rng, 60, 5000) + " " + passage, sentence(rng, 60, 5000) + " " + passage]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, at = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, str(tmp_path)), name)
        at.append({r.doc_id: r for r in docs.collect()})
    gone = [set(a) - set(b) for a, b in zip([dict(enumerate(texts)), *at[:-1]], at, strict=True)]
    assert gone == [{32, 33}, {30, 31}, set(), {34}, set()]
    cut = passage.encode()[: len(passage)].decode()
    assert cut not in at[2][35].text and at[2][35].n_chars == len(at[2][35].text) and at[2][5].text == clean[5]
    assert all(set(DOCS.replace("bigint", "").replace("string", "").replace(",", "").split()) == set(a[2].asDict()) for a in at[:-1])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(at[-1])
