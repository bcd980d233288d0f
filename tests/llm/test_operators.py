"""Each operator against a plain version of itself, and on awkward tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseframe.llm import chat, common, components, exact_dedup, mixing, near_dedup, pieces, pii, quality, sharding, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, __x long"


def table(spark, rows):
    """rows: (doc_id, text, source); the other columns have names that clash with what operators use."""
    return spark.createDataFrame([(i, t, "en", s, None, "shard", "slot", 1) for i, t, s in rows], SCHEMA)


AWKWARD = [
    (1, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (None, None, None), (None, "", "x"), (3, "", None), (4, " \t\n", "y"),
    (5, "word", "y"), (6, "é ü \u2028 \U0001f600", "y"), (7, "long " * 30_000, "z"), (8, "x" * 100_000, "z"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return table(spark, AWKWARD).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def sentences(n, seed=1, size=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(1, size))) for _ in range(n)]


# ---- 1


def test_shards_are_exact_and_gapless(spark, awkward, empty):
    for df, n in ((awkward, len(AWKWARD)), (empty, 0)):
        got = sharding.shard_rows(df, 4, block_rows=2).collect()
        assert len(got) == n
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        assert sorted((len(by[j]) for j in range(4)), reverse=True) == sharding.shard_sizes(n, 4)
        assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((i, t) for i, t, _ in AWKWARD if n)


def test_blocks_have_bounded_bytes(spark, monkeypatch):
    seen = []
    blocks_of = sharding.blocks_of
    monkeypatch.setattr(sharding, "blocks_of", lambda sizes, rows: seen.append(rows) or blocks_of(sizes, rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 28))
    df = table(spark, [(i, "x" * 50_000, "x") for i in range(60)]).repartition(2)
    monkeypatch.setattr(sharding, "BLOCK_BYTES", 500_000)
    got = sharding.shard_rows(df, 3).collect()
    assert seen == [9] and sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(3) for i in range(20)]
    assert all(r.text == "x" * 50_000 for r in got) and sorted(r.doc_id for r in got) == list(range(60))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == common.BATCH_BYTES


def test_matrix_has_exact_margins_and_the_right_law():
    counts, room = np.array([3, 0, 5, 4]), np.array([4, 4, 4])
    rows = np.array([sharding.matrix_row(counts, room, i, 7) for i in range(4)])
    assert (rows.sum(axis=1) == counts).all() and (rows.sum(axis=0) == room).all()
    draws = collections.Counter(int(sharding.matrix_row(np.array([2, 2]), np.array([2, 2]), 0, s)[0]) for s in range(3000))
    assert abs(draws[1] / 3000 - 4 / 6) < 0.04 and abs(draws[0] / 3000 - 1 / 6) < 0.03


def test_large_hypergeometric_draws():
    rng = np.random.default_rng(1)
    got = [sharding._hypergeometric(2 * 10**9, 10**9, 10**6, rng) for _ in range(200)]
    assert abs(np.mean(got) - 2e6 / 3) < 200 and 300 < np.std(got) < 650


def test_shuffle_is_uniform(spark):
    df = spark.range(6).withColumnRenamed("id", "doc_id").repartition(3)
    seen = collections.Counter()
    for seed in range(40):
        for r in sharding.shard_rows(df, 2, seed).collect():
            seen[r.doc_id, r.shard] += 1
    assert all(8 <= seen[i, 0] <= 32 for i in range(6))


# ---- 2


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def test_ids_are_the_librarys(spark, awkward, empty, vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for _, t, _ in AWKWARD] + sentences(50) + ["  two  spaces ", "</s><s>[INST]", "▁ mark", "tab\tline\n\nend", "日本語 naïve", "ab" * 100]
    df = table(spark, [(i, t, "x") for i, t in enumerate(texts)])
    for head in (200, None):
        for r in pieces.encode(df, vocabulary, head=head).collect():
            text = texts[r.doc_id] or ""
            assert r.ids == sp.encode(text) and r.n_tokens == len(r.ids)
            assert r.decoded == text.replace("▁", " ")
        assert pieces.encode(empty, vocabulary, head=head).count() == 0
        assert pieces.encode(awkward, vocabulary, head=head).count() == len(AWKWARD)


def test_relational_fold_is_the_plain_one(spark, vocabulary):
    words = sorted({w for t in sentences(30) for w in vocabulary.words(t)} | {" ééé", "zzz", " ", "   x"})
    got = pieces.folded(spark.createDataFrame([(w,) for w in words], "word string"), vocabulary).collect()
    assert len(got) == len(words)
    for r in got:
        assert [x for i in r.ids for x in ([i] if i >= 0 else vocabulary.other(chr(-1 - i)))] == vocabulary.fold(r.word)


def test_best_paths_of_unigram_models(spark):
    scores = {"▁": -3.0, "a": -4.0, "b": -4.1, "c": -4.2, "ab": -5.0, "bc": -4.5, "abc": -8.9, "▁a": -5.1, "▁ab": -9.0}
    v = pieces.Vocabulary({p: (i, s) for i, (p, s) in enumerate(scores.items())}, (), 99, merges=False)
    words = [" " + "".join(x) for n in range(1, 5) for x in itertools.product("abcq", repeat=n)]

    def brute(word):
        word = word.replace(" ", "▁")
        best = None
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[at:i])
                    at = i
            parts.append(word[at:])
            if all(p in scores or len(p) == 1 for p in parts):
                s = sum(scores.get(p, -8.9 - 0.1 - 10) if p in scores else min(scores.values()) - 10 for p in parts)
                best = s if best is None or s > best else best
        return best

    got = {r.word: r.ids for r in pieces.folded(spark.createDataFrame([(w,) for w in words], "word string"), v).collect()}
    score = {i: s for i, s in enumerate(scores.values())}
    low = min(scores.values()) - 10
    for w in words:
        assert abs(sum(score.get(i, low) for i in got[w]) - brute(w)) < 1e-6
        assert abs(sum(score.get(i, low) for i in v.fold(w)) - brute(w)) < 1e-6


def test_many_texts_are_decoded_as_one_by_one(vocabulary, monkeypatch):
    rng = random.Random(20)
    lists = [[], [0], [-1, 10**6], *([rng.randrange(32_000) for _ in range(rng.randrange(60))] for _ in range(40)), vocabulary.fold(" hello"), [3 + b for b in "é".encode()]]
    for most in (7, 500_000):
        monkeypatch.setattr(pieces, "DECODE_IDS", most)
        flat = np.array([i for x in lists for i in x], dtype=np.int32)
        assert vocabulary.decode_many(flat, np.cumsum([len(x) for x in lists]).tolist()) == [vocabulary.decode(x) for x in lists]


def test_decode_table(spark, vocabulary):
    df = spark.createDataFrame([(1, vocabulary.fold(" hello")), (2, None), (3, [])], "k long, ids array<int>")
    assert {r.k: r.decoded for r in pieces.decode(df, vocabulary).collect()} == {1: "hello", 2: None, 3: ""}


# ---- 3


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"k" * 16)
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(f.permute("t", n, i) for i in range(n)) == list(range(n))


def test_pseudonyms_keep_formats_and_links(spark, awkward, empty):
    key = "0123456789abcdef"
    texts = [
        "card 4316522678525456 and 4111 1111 1111 1111, not 4316522678525457", "call +1 (663) 555-6869", "ip 233.233.171.252 not 999.1.1.1", "born 2024-02-29, 29/02/2024, not 31/02/2024",
        "ssn 123-45-6789 not 000-12-3456", "DE89 3704 0044 0532 0130 00", "bob.s@mail2.example.com", "again 4316522678525456 233.233.171.252", "plain text 12 345 v1.2.3",
    ]
    got = {r.doc_id: r for r in pii.pseudonyms(table(spark, [(i, t, "x") for i, t in enumerate(texts)]), key).collect()}
    for i, t in enumerate(texts):
        assert re.sub(r"[0-9]", "9", re.sub("[A-Za-z]", "a", got[i].text)) == re.sub(r"[0-9]", "9", re.sub("[A-Za-z]", "a", t))
    cards = re.findall(r"\d{16}", got[0].text)
    assert pii.luhn(cards[0]) and cards[0] != "4316522678525456" and cards[1] == "4316522678525457"
    assert cards[0] in got[7].text and re.search(r"[\d.]{7,}", got[2].text)[0] in got[7].text
    assert "999.1.1.1" in got[2].text and "31/02/2024" in got[3].text and "000-12-3456" in got[4].text
    assert pii.iban_ok(got[5].text.replace(" ", "")) and got[6].text.endswith("@mail2.example.com") and got[8].text == texts[8]
    assert (got[0].n_card, got[1].n_phone, got[2].n_ip, got[3].n_date, got[4].n_ssn, got[5].n_iban, got[6].n_email) == (2, 1, 1, 2, 1, 1, 1)
    assert pii.pseudonyms(empty, key).count() == 0 and pii.pseudonyms(awkward, key).count() == len(AWKWARD)
    with pytest.raises(ValueError, match="key"):
        pii.pseudonyms(empty, "short")


CARD, CARD4, IBAN, IBAN4 = "4111111111111111", "4111 1111 1111 1111", "AT611904300234573201", "AT61 1904 3002 3457 3201"


@pytest.mark.parametrize(("value", "text"), [
    *((CARD, x) for x in ("{} 123", "12 {}", "{}-123", "12-{}", "7 {} 7", "{} 12 2025", "{} 4012888888881881", "{} 9.50")),
    *((CARD4, x) for x in ("{} 12/25", "12 {}", "{} 123", "1 2 3 4 5 {}", "29/02/2024 {}", "123-45-6789 {}", "{} 1234567", "{}-1234567", "{} 1a")),
    *((IBAN, x) for x in ("{} EUR", "AB12 {}", "{} EUR 12", "{} BANK AT99 1904")),
    *((IBAN4, x) for x in ("{} EUR", "AB12 {}", "AB12 CDEF {} EURO", "{} {} EUR", "{} BIC BKAUATWW")), ("ES91 2100 0418 4502 0005 1332", "{} BBVA"), ("PL61109010140000071219812874", "{} PLN"), ("BE68 5390 0754 7034", "{} KBC"),
])
def test_numbers_beside_cards_and_ibans(value, text):
    f = pii.Feistel(b"k" * 16)
    alone, counts = pii.pseudonymize(value, f)
    kind = "card" if value[0] == "4" else "iban"
    assert alone != value and counts[kind] == 1
    got, counts = pii.pseudonymize(text.format(*[value] * text.count("{}")), f)
    assert value not in got and got.count(alone) == text.count("{}") and counts[kind] == text.count("{}") + ("40128" in text)
    beside = text.format("", "").replace("4012888888881881", "").split()
    assert "/" in text or "123-45" in text or all(x in got for x in beside)  # a date and an SSN get pseudonyms too


def test_values_are_found_in_any_text():
    """A text of values and words between marks is what each value gives alone; places of spans don't matter."""
    f, rng = pii.Feistel(b"k" * 16), random.Random(18)
    parts = [CARD, CARD4, IBAN, "+1 (663) 555-6869", "233.233.171.252", "2024-02-29", "123-45-6789", "bob.s@mail2.example.com", "0123456789abcdef" * 2, "plain", "12", "v1.2.3", "31/02/2024", "999.1.1.1"]
    for n in (3, 40, 3000):
        chosen = [rng.choice(parts) for _ in range(n)]
        got, counts = pii.pseudonymize("; ".join(chosen), f)
        assert got == "; ".join(pii.pseudonymize(x, f)[0] for x in chosen)
        assert sum(counts.values()) == sum(x not in ("plain", "12", "v1.2.3", "31/02/2024", "999.1.1.1") for x in chosen)


def test_days_and_names_are_linked_as_wholes():
    f = pii.Feistel(b"k" * 16)
    one = lambda x: pii.pseudonymize(x, f)[0]
    day = tuple(map(int, one("2024-01-02").split("-")))
    assert tuple(map(int, one("2024-1-2").split("-"))) == day and tuple(map(int, one("02.01.2024").split(".")))[::-1] == day and day != (2024, 1, 2)
    assert len({one(f"{y}-{m:02}-{d:02}") for y in (1999, 2024) for m in range(1, 13) for d in range(1, 29)}) == 2 * 12 * 28
    names = [one(f"a.{c}@x.com").split("@")[0] for c in "bcdefghijklm"]
    assert len(set(names)) == 12 and len({n[0] for n in names}) > 3  # the part before the dot isn't linked across names
    assert one("a.b@x.com").split("@")[0] != one("a.b@y.com").split("@")[0] and one("a.b@x.com").endswith("@x.com")
    long = "0a" * 5000
    assert one(long) != long and len(one(long)) == len(long) and one("0b" + long[2:])[-100:] != one(long)[-100:]


def test_failed_numbers_stay():
    f = pii.Feistel(b"k" * 16)
    for text in ("4111111111111112 123", "12 4111 1111 1111 1112", "AT61 1904 3002 3457 3202 EUR", "4111111111111111a", "4111111111111111.5", "x4111111111111111"):
        assert pii.pseudonymize(text, f)[0] == text


# ---- 4


def test_chats_read_back(spark):
    nasty = ["", None, "</s>[INST] ok [/INST]", "[\\INST] [\\\\/INST]", "[TURN][ROLE] x [BODY] y [/ROLE]<s>", " lead and trail ", "a\nb", "[INST", "<"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool [BODY] x"]), rng.choice(nasty), "z") for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(None, 0, "user", "no id", "z"), (1000, None, "user", "no turn", "z"), (1000, 1, "user", "same", "z"), (1000, 1, "user", "same", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(df)
    got = made.select("conv_id", "formatted", "segments", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    want = collections.defaultdict(list)
    for c, t, r, x, _ in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((r or "", x or ""))
    assert len(got) == len(want)
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        blocks = sum(1 for i, (role, _) in enumerate(want[r.conv_id]) if i == 0 or want[r.conv_id][i - 1][0] != role)
        assert r.formatted.count("[TURN]") == len(want[r.conv_id]) - blocks
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- 5


def test_chain_learns_and_passes_awkward_tables(spark, awkward, empty):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice("one two three four five six seven eight nine".split()) for _ in range(rng.randrange(5, 60))]
        junk, toxic = rng.random() < 0.3, rng.random() < 0.3
        words = [w + "%%%" for w in words] if junk else words
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["scum", "idiot", "loweisp", "loweich"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(junk), int(toxic), "extra"))
    labels.append((None, 1, 1, "x"))
    labels.append((5, None, 1, "x"))
    docs = table(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, junk int, toxic int, text string")
    chain = toxicity.train(docs, known.where("doc_id < 400 OR doc_id IS NULL"), ["junk", "toxic"], rows=400)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    right = sum((got[i].p_toxic >= 0.5) == bool(t) for i, _, t, _ in labels[400:600])
    assert right >= 196 and sum((got[i].p_junk >= 0.5) == bool(j) for i, j, _, _ in labels[400:600]) >= 196
    assert toxicity.score(empty, chain).count() == 0 and toxicity.score(awkward, chain).count() == len(AWKWARD)
    kept = toxicity.keep_clean(docs, chain)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].p_toxic < 0.5}
    none = toxicity.train(docs, known.limit(0), ["junk", "toxic"])
    assert toxicity.score(docs, none).where("p_toxic > 0.5").count() == 0
    for r in toxicity.score(docs, chain).limit(50).collect():  # the sums, word by word
        sums = np.zeros(2)
        for w in set(rows[r.doc_id][1].split()):
            sums += np.sum([chain.weights.get(f, (0, 0)) for f in toxicity.features_of(w)], axis=0)
        z = sums[0] + chain.biases[0]
        first = np.log(np.clip(1 / (1 + np.exp(-z)), 0.01, 0.99) / (1 - np.clip(1 / (1 + np.exp(-z)), 0.01, 0.99)))
        assert r.p_junk == pytest.approx(1 / (1 + np.exp(-z))) and r.p_toxic == pytest.approx(1 / (1 + np.exp(-(sums[1] + chain.biases[1] + chain.links[1][0] * first))))


def test_labels_and_repeated_rows_are_defined(spark):
    """Of several labels the larger counts, of several texts the smallest; a very frequent row is one row of the sample."""
    docs = table(spark, [(1, "b", "x")] * 200 + [(1, "a bad", "x"), (2, "fine", "x"), (3, None, "x"), (4, "y" * 60_000, "x")])
    known = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (4, 1), (None, 1)], "doc_id long, toxic int")
    chain = toxicity.train(docs, known, ["toxic"], rows=10)
    plain = toxicity.fit_chain([np.array([f for w in toxicity.words_of(t) for f in toxicity.features_of(w)], dtype=np.int32) for t in ("a bad", "fine")], np.array([[1.0], [0.0]]), ["toxic"])
    assert chain.weights == plain.weights and chain.biases == plain.biases
    assert [r.doc_id for r in toxicity.score(docs, chain).groupBy("doc_id").count().where("count = 201").collect()] == [1]


# ---- 6


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups_are_those_of_a_dict(spark, empty, keep):
    rng = random.Random(6)
    pool = ["", None, "same start " * 10 + "a", "same start " * 10 + "b", "hot", "x" * 50_000, *sentences(20)]
    rows = [(rng.choice([None, *range(500)]), "hot" if i % 3 == 0 else rng.choice(pool), "s") for i in range(900)]
    got = exact_dedup.exact_groups(table(spark, rows).repartition(7), keep=keep, carry=True).collect()
    by = collections.defaultdict(list)
    for i, t, _ in rows:
        by[t or ""].append(i)
    best = {t: (max if keep == "largest" else min)((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in by}
    assert collections.Counter((r["__id"], digest[r.text_sha256]) for r in got) == collections.Counter((i, t or "") for i, t, _ in rows)
    for r in got:
        t = digest[r.text_sha256]
        assert r.keep_id == best[t] and r.group_size == len(by[t])
    kept = [r for r in got if r.kept]
    assert len(kept) == len(by) and all(r["__id"] == r.keep_id and (r["__row"].text or "") == digest[r.text_sha256] for r in kept)
    assert exact_dedup.exact_groups(empty, keep=keep).count() == 0


def test_exact_copies_leave_whole_rows(spark, awkward, empty):
    got = exact_dedup.drop_exact_duplicates(awkward, keep="largest")
    assert got.columns == awkward.columns and got.count() == len({t or "" for _, t, _ in AWKWARD})
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


# ---- 7


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """rows: (doc_id, text) with distinct identifiers."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, sets


def test_near_groups_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    base = sentences(40, 7, 200)
    texts = list(base)
    for t in base[:15]:
        for _ in range(rng.randrange(1, 25)):  # copies with few or many changed words, around the threshold
            w = t.split()
            for _ in range(rng.randrange(0, max(2, len(w) // 18))):
                w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else "  ".join(w))
    texts += ["", None, "A b", "a  B", "one", "\t\n"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want, sets = brute_components(rows)
    got = near_dedup.near_groups(table(spark, [(i, t, "x") for i, t in rows]).repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i, _ in rows}
    assert len(set(want.values())) < len(rows) - 20


def test_near_groups_in_large_buckets(spark, monkeypatch):
    """A bucket of more than one block, with members that are linked only through others."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(8)
    w = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        if i % 20 == 0:
            w = list(w) if i else w
        v = list(w)
        for _ in range(3):
            v[rng.randrange(len(v))] = f"n{i}x{rng.randrange(100)}"
        if i % 4 == 0:
            w = v  # the family drifts
        rows.append((i, " ".join(v)))
    want, _ = brute_components(rows)
    got = near_dedup.near_groups(table(spark, [(i, t, "x") for i, t in rows])).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_groups_look_a_class_up_once(spark, monkeypatch):
    """However many buckets a class shares: what is joined with sketches and sets has a row for each class."""
    rng, rows, seen, write = random.Random(8), [], [], near_dedup.materialize
    w = [f"w{i}" for i in range(120)]
    for i in range(60):
        v = list(w)
        for _ in range(4):
            v[rng.randrange(len(v))] = f"n{i}x{rng.randrange(100)}"
        rows.append((i, " ".join(v)))

    def noted(df, tag, *more):
        made = write(df, tag, *more)
        if tag == "near-open":
            seen.append((made.count(), made.select("node").distinct().count()))
        return made

    monkeypatch.setattr(near_dedup, "materialize", noted)
    want, _ = brute_components(rows)
    got = near_dedup.near_groups(table(spark, [(i, t, "x") for i, t in rows])).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: want[i] for i, _ in rows}
    assert seen and all(n == nodes > 3 for n, nodes in seen)


def test_near_groups_read_sets_only_where_sketches_allow_a_link(spark, monkeypatch):
    """Classes that share large buckets but can't be linked: their sketches go there, their sets aren't read."""
    rng, rows, seen, write = random.Random(8), [], [], near_dedup.materialize
    w = [f"w{i}" for i in range(120)]
    for i in range(60):
        v = list(w)
        for at in rng.sample(range(120), 12):
            v[at] = f"n{i}x{rng.randrange(100)}"
        rows += [(3 * i + k, " ".join([*v[: 118 + k]])) for k in range(2 if i < 5 else 1)]

    def noted(df, tag, *more):
        made = write(df, tag, *more)
        if tag in ("near-open", "near-sets"):
            seen.append((tag, made.count()))
        return made

    monkeypatch.setattr(near_dedup, "materialize", noted)
    want, _ = brute_components(rows)
    got = near_dedup.near_groups(table(spark, [(i, t, "x") for i, t in rows])).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) == 60
    (open_,), (_, sets) = ([n for t, n in seen if t == tag] for tag in ("near-open", "near-sets"))
    assert open_ > 30 and sets < open_ // 4


def test_near_groups_of_awkward_tables(spark, awkward, empty):
    got = near_dedup.near_groups(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id in (1, 2, 7)) == [(1, 1), (2, 1), (2, 1), (7, 7)]
    assert near_dedup.near_groups(empty).count() == 0
    assert near_dedup.drop_near_duplicates(awkward).columns == awkward.columns


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(9)
    for share in (0.3, 0.6, 0.75, 0.9):
        errors = []
        for _ in range(40):
            n = 600
            k = round(2 * n * share / (1 + share))
            members = rng.integers(0, 2**63, 2 * n - k, dtype=np.uint64)
            a, b = np.unique(members[:n]), np.unique(members[n - k :])
            ra, rb = near_dedup.registers(a), near_dedup.registers(b)
            assert (np.maximum(ra, rb) == near_dedup.registers(np.union1d(a, b))).all()
            errors.append(near_dedup.estimate(ra[None], rb[None], np.array([float(len(a))]), np.array([float(len(b))]))[0] - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_estimate_is_the_likeliest():
    rng = np.random.default_rng(10)
    na, nb = rng.integers(300, 600, 200).astype(float), rng.integers(300, 600, 200).astype(float)
    a = rng.integers(0, 3, (200, near_dedup.REGISTERS))
    b = np.where(rng.random(a.shape) < 0.75, a, rng.integers(0, 3, a.shape))
    got = near_dedup.estimate(a, b, na, nb)
    for i in range(200):
        above, below, u = (a[i] > b[i]).sum(), (a[i] < b[i]).sum(), na[i] / (na[i] + nb[i])
        j = np.linspace(0, min(u / (1 - u), (1 - u) / u) * (1 - 1e-9), 20_001)
        p, q = (-np.log1p(-np.maximum(x, 0) * (near_dedup.BASE - 1) / near_dedup.BASE) / np.log(near_dedup.BASE) for x in (u - (1 - u) * j, 1 - u - u * j))
        like = above * np.log(np.maximum(p, 1e-12)) + below * np.log(np.maximum(q, 1e-12)) + (len(a[i]) - above - below) * np.log(np.maximum(1 - p - q, 1e-12))
        assert abs(got[i] - j[like.argmax()]) < 1 / 900  # the last round's step is 1/1024


def test_components_of_random_graphs(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4100)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_components_of_few_links_take_few_tasks(spark, monkeypatch):
    """However many partitions a shuffle has: a forest sees as many links as a task may hold."""
    rng, write = random.Random(11), components.materialize
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2000)]
    monkeypatch.setattr(components, "materialize", lambda df, tag: files.append(len((made := write(df, tag)).inputFiles())) or made)
    files, held = [], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("32", "false"), strict=True):
            spark.conf.set(k, v)
        got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert files and max(files) <= 4
    assert all(got[a] == got[b] for a, b in edges if a != b) and all(got[c] == c <= x for x, c in got.items())


# ---- 8


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))

    def covered(n):
        seen = collections.defaultdict(list)
        for i in range(len(words) - n + 1):
            seen[tuple(words[i : i + n])].append(i)
        return {i + j for v in seen.values() if len(v) > 1 for i in v for j in range(n)}

    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    repeat = len(covered(8))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    grams = [sum(len(words[i]) for i in covered(n)) for n in quality.MOST_COVERED]
    good = all(100 * c <= m * chars for c, m in zip(grams, quality.MOST_COVERED.values(), strict=True)) and 100 * sum(map(len, again)) <= 20 * sum(map(len, lines))
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(again), repeat, sum(map(len, again)), sum(map(len, lines)), grams, failed, good and not failed)


def test_quality_is_the_plain_one(spark, empty):
    rng = random.Random(11)
    texts = [t for _, t, _ in AWKWARD] + sentences(40, 11, 120) + [" ".join(f"w{i}" for i in range(30_000))]
    for t in sentences(30, 12, 60):
        w = t.split()
        texts.append("\n".join([" ".join(w), " ".join(w[: rng.randrange(1, len(w) + 1)]), " ".join(w), "# | <b>"]))
    texts += [" ".join(["ab"] * 50), "x " * 19, "y " * 20]
    df = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for r in quality.repetition_quality(df).collect():
        assert tuple(r)[1:] == plain_quality(texts[r.doc_id])
    assert quality.repetition_quality(empty).count() == 0


def test_quality_survives_collisions(monkeypatch):
    monkeypatch.setattr(quality, "_MULTIPLIER", np.uint64(0))  # windows with one last word collide
    texts = sentences(20, 13, 100)
    got = quality.measure(texts)
    assert got["n_repeat_words"].tolist() == [plain_quality(t)[4] for t in texts]


# ---- 9


def plain_targets(sizes, weights, most=3):
    """Shares of all sizes by weight; as long as any is above its limit, it is held there and the rest shared anew."""
    held = {}
    while True:
        rest = sum(sizes) - sum(held.values())
        free = [i for i, (n, w) in enumerate(zip(sizes, weights, strict=True)) if i not in held and n and w]
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > most * sizes[i]]
        if not over:
            return [float(held.get(i, share.get(i, 0))) for i in range(len(sizes))]
        held |= {i: most * sizes[i] for i in over}


def planned(spark, sizes, weights=None):
    rows = spark.createDataFrame(sizes, "__source string, n long").repartition(3)
    return mixing.plan_sources(rows, weights, 16).orderBy("number").collect()


def test_targets_reshare_what_is_above(spark):
    got = planned(spark, [("b", 10), (None, 100), ("a", 10)])
    assert [r["__source"] for r in got] == ["a", "b", None]
    assert [r.target for r in got] == pytest.approx([22.5, 30.0, 67.5])  # 40 is above 30: 10 more for the others, by 1 and 3
    assert [r.target for r in planned(spark, [("x", 0), ("y", 5)], {"x": 1, "y": 1})] == [0.0, 5.0] and planned(spark, []) == []
    rng = random.Random(13)
    for _ in range(3):
        sizes = [(f"s{i:02}", rng.choice([0, 1, 5, 40, 1000])) for i in range(rng.randrange(1, 30))]
        got = planned(spark, sizes)
        assert [r.target for r in got] == pytest.approx(plain_targets([n for _, n in sizes], [i % 3 + 1 for i in range(len(sizes))]))
        assert all(r.words == round(r.target) or abs(r.words - r.target) <= 0.5 for r in got)


def test_permutations_run_back(spark):
    x, n, key = F.col("id"), F.lit(100), F.lit(9)
    assert spark.range(100).where(mixing.permuted(mixing.permuted(x, n, key), n, key, back=True) != x).count() == 0


def test_mix_in_bundles(spark, monkeypatch):
    """More sources than the driver draws for: several share a bundle."""
    monkeypatch.setattr(mixing, "MOST_BUNDLES", 3)
    rows = [(i, t, f"s{i % 11}") for i, t in enumerate(sentences(200, 17, 60))]
    m = mixing.mix(table(spark, rows), block_words=16, shards=4)
    taken, words = collections.Counter(), {r["__source"]: r.words for r in m.sources.collect()}
    for r in mixing.taken_words(m).collect():
        taken[r["__source"]] += r.taken
    assert dict(taken) == words
    slots = m.slots.collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots) and len({(r["__source"], r["__times"], r["__block"]) for r in slots}) == len(slots)
    by_shard = collections.Counter(r.shard for r in slots)
    assert len(by_shard) == 4 and max(by_shard.values()) - min(by_shard.values()) <= 11 and all(len({r["__source"] for r in slots if r.shard == k}) > 5 for k in range(4))


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, None, "a")], [(7, "word " * 40_000, "long"), (8, "one two", None)]])
def test_mix_of_awkward_tables(spark, rows):
    m = mixing.mix(table(spark, rows))
    got = {r["__row"].doc_id: r.taken for r in mixing.taken_words(m).collect()}
    size = {i: len((t or "").split()) for i, t, _ in rows}
    assert set(got) == set(size) and all(got[i] <= 3 * n for i, n in size.items())
    assert sum(got.values()) == sum(r.words for r in m.sources.collect())


def test_permutations_of_any_size(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5))).collect()
        assert sorted(r[0] for r in got) == list(range(n))


def test_mix_takes_exactly_its_targets(spark, empty):
    rng = random.Random(14)
    texts = sentences(300, 14, 80)
    rows = [(i if i % 50 else None, t if i % 40 else None, "hot" if i % 3 == 0 else rng.choice(["a", "b", None])) for i, t in enumerate(texts)]
    rows += [(7, "twice the same row", "a")] * 2 + [(8, "", "empty source")]
    m = mixing.mix(table(spark, rows).repartition(4), block_words=16, shards=5)
    got = mixing.taken_words(m).collect()
    again = mixing.taken_words(mixing.mix(table(spark, rows).repartition(4), block_words=16, shards=5)).collect()
    key = lambda r: (r["__row"].doc_id or -1, r["__row"].text or "", r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert len(got) == len(rows)
    size, taken = collections.Counter(), collections.Counter()
    for r in got:
        assert r["__size"] == len(WORD.findall(r["__row"].text or "")) and r.taken <= 3 * r["__size"]
        size[r["__source"]] += r["__size"]
        taken[r["__source"]] += r.taken
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, plain_targets([size[s] for s in names], [i % 3 + 1 for i in range(len(names))]), strict=True))
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in names)
    texts_out = mixing.mixed_documents(m).collect()
    assert sum(len(WORD.findall(r.text)) for r in texts_out) == sum(taken.values())
    slots = m.slots.collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots)
    assert mixing.taken_words(mixing.mix(empty)).count() == 0


# ---- 10


def test_rules_and_parts(spark):
    urls = ["http://WWW.Example.com/en/1?x=1#y", "https://a.example.com/en/2", "x.net/es/", None, "", "ftp://net/es/1", "http://h.net/fr/?q", "http://org", "a://b://c/d", "http://example.com?x/en/"]
    rules = [url_filter.Rule("allow", "com"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/")]
    df = spark.createDataFrame([(i, u, "html") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df, rules, None).collect()}

    def plain(u):
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        return host, path, best and best.name, best and best.verdict

    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == plain(u)
    assert url_filter.judge(df.limit(0), rules, None).count() == 0


def test_trees_learn_lexical_labels(spark):
    rng = random.Random(15)
    rows = []
    for i in range(3000):
        bad = rng.random() < 0.4
        host = f"{'x-' * rng.randrange(2, 4) if bad else ''}site{rng.randrange(400)}.{rng.choice(['com', 'org'])}"
        rows.append((f"http://{host}/p{rng.randrange(10**6)}{'?a=1&b=2' if bad and rng.random() < 0.7 else ''}", bad))
    train, held = rows[:2000], rows[2000:]
    model = url_filter.train(spark.createDataFrame(train, "url string, blocked boolean"), rows=1500)
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df, [], model).collect()}
    assert sum((got[i] == "block") == b for i, (_, b) in enumerate(held)) >= 970
    none = url_filter.train(spark.createDataFrame([], "url string, blocked boolean"))
    assert {r.verdict for r in url_filter.judge(df, [], none).collect()} == {"allow"}


def test_frequent_url_leaves_places_to_others(spark):
    urls = spark.createDataFrame([(f"http://site{i}.com/p", i % 3 == 0) for i in range(200)], "url string, blocked boolean")
    hot = urls.orderBy(F.xxhash64(F.lit(1), "url")).first()  # its copies would come first
    copies = spark.range(300).select(F.lit(hot.url).alias("url"), F.lit(hot.blocked).alias("blocked"))
    alone, crowded = (url_filter.train(t, rows=100) for t in (urls, urls.unionByName(copies)))
    assert crowded.suffixes == alone.suffixes and crowded.suffixes["com"][0] == 100 and 0 < crowded.share < 1


def test_crc_is_unsigned(spark):
    assert spark.range(1).select(F.crc32(F.encode(F.lit("é x"), "UTF-8"))).first()[0] == zlib.crc32("é x".encode())
