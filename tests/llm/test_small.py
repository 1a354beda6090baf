"""Small fixtures: brute force, round trips and the defined edge cases."""

from __future__ import annotations

import itertools
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tickerweave.llm import blocks, common, edit_embedding, graph, minhash, mixing, quality, runs, sentencepiece_scan, token_counts, toxicity, unigram

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key string, s string"


def table(spark, rows):
    """rows: (doc_id, text[, source]); with columns whose names clash with internal ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None, "x", "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA).drop("__key")


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


ODD = [(None, "null id text here", None), (1, None), (2, ""), (2, ""), (3, " \n\t"), (4, "!!! ??? ..."), (5, "a"), (None, None, None)]


def all_ops(spark, docs, labels):
    return {
        "toxicity": toxicity.toxicity(docs, labels),
        "runs": runs.run_repeats(docs),
        "minhash": minhash.near_duplicates(docs),
        "edit": edit_embedding.edit_groups(docs),
        "quality": quality.quality(docs, labels, rows=64, dims=16),
        "blocks": blocks.block_repeats(docs),
        "encode": sentencepiece_scan.encode(docs),
        "mixing": mixing.mix_sources(docs),
        "counts": token_counts.token_counts(docs),
    }


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_odd_rows_and_empty_tables(spark):
    docs, labels = table(spark, ODD), labels_of(spark, [(5, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, None)])
    got = {k: v.collect() for k, v in all_ops(spark, docs, labels).items()}
    for k in ("toxicity", "quality", "encode", "counts", "mixing"):
        assert len(got[k]) == len(ODD), k
    for k in ("runs", "minhash", "edit", "blocks"):
        assert got[k] == [], k
    none = {k: v.count() for k, v in all_ops(spark, docs.limit(0), labels_of(spark)).items()}
    assert set(none.values()) == {0}


def test_clashing_columns_come_through(spark):
    names = ["__key", "__n", "__s", "__tox", "__cuts", "__rank", "__keep", "keep", "comp", "n", "a", "score"]
    rows = [(i, f"text of row {i}", "en", "a", 5, *[f"{c}{i}" for c in names]) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    for got in (toxicity.reject_toxic(spark, docs, None), minhash.one_of_each(docs), runs.cut_copies(spark, docs), mixing.mix_sources(docs)):
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect())) == sorted(rows)
    for op in all_ops(spark, docs, labels_of(spark)).values():
        op.collect()


# --- toxicity ---------------------------------------------------------------


MACHINES = toxicity.grammar()


def score(text):
    return toxicity.clause_scores(text, toxicity.Lexicon([]), MACHINES)


def brute_score(text):
    """The same rules looked up around each word, without transducers (for texts without phrases)."""
    lex, out = toxicity.Lexicon([]), []
    codes = [toxicity.CLASS.get(c, c) for c in (lex[t] for t in toxicity.TOKEN.findall(text.lower()))]
    parts = [[]]
    for c in codes:
        if c == toxicity.STOP:
            parts.append([])
        else:
            parts[-1].append(c)
    T = toxicity
    breaks = (T.COMMA, T.BUT)
    for p in parts:
        n, kind, clause = len(p), {}, [sum(c in breaks for c in p[: i + 1]) for i in range(len(p))]
        inside = lambda i, k: [j for j in range(max(0, i - k), i) if clause[j] == clause[i]]
        negated = [p[i] in (T.INSULT, T.VERB) and any(p[j] == T.NOT for j in inside(i, T.SCOPE)) for i in range(n)]
        for i in range(n):
            if negated[i]:
                continue
            if p[i] == T.INSULT:
                kind[i] = "insult"
            if p[i] == T.VERB:
                begins = i == 0 or p[i - 1] in breaks
                meant = any(p[j] == T.WILL for j in inside(i, T.MEANT))
                if meant and any(p[j] == T.BEFORE for j in inside(i, T.REACH)):
                    kind[i] = "strong"
                    continue
                left, j = T.REACH, i + 1
                while j < n and p[j] not in breaks:
                    if p[j] in (T.PERSON, T.GROUP, T.BEFORE) or (p[j] == T.KIN and p[j - 1] == T.OWN):
                        kind[j] = "strong" if meant or begins else "weak"
                        break
                    if p[j] == T.SKIP:
                        left -= 1
                    if p[j] not in (T.SKIP, T.OWN) or left <= 0:
                        break
                    j += 1
        said_from = next((i for i in range(n) if p[i] == T.SAYS), n)
        tail = [c for c in reversed(p)]
        k, before = 0, 0
        while k < len(tail) and tail[k] == T.COMMA:
            k += 1
        words_read = 0
        while k < len(tail) and words_read < 3 and tail[k] not in (T.SAYS, T.COMMA):
            k, words_read = k + 1, words_read + 1
        if k < len(tail) and tail[k] == T.SAYS:
            k += 1
            while k < len(tail) and tail[k] in (T.PERSON, T.GROUP, T.FILL):
                k += 1
            if k < len(tail) and tail[k] == T.COMMA:
                before = n - k - 1
        target, pending, got = 0, 0, [0.0] * n
        for i in range(n):
            said = i > said_from or i < before
            what = kind.get(i)
            if what in ("strong", "weak"):
                got[i] = ({"strong": 0.5, "weak": 0.0} if said else {"strong": 3.0, "weak": 1.0})[what]
                target, pending = T.NEAR, 0
            elif p[i] in (T.PERSON, T.GROUP, T.BEFORE, T.OWN):
                got[i] = 1.0 if pending else 0.0
                target, pending = T.NEAR, 0
            elif what == "insult":
                got[i] = (0.5 if said else 2.0) if target else (0.25 if said else 1.0)
                pending = 0 if target else T.NEAR
            else:
                target, pending = max(0, target - 1), max(0, pending - 1)
        for c in dict.fromkeys(clause):
            total = sum(g for g, x in zip(got, clause) if x == c)
            if total:
                out.append(total)
    return out


def test_toxicity_rules():
    assert score("You are an idiot.") == [2.0]
    assert sum(score("idiot, you")) == 2.0
    assert score("You are not an idiot.") == score("du bist kein Idiot") == score("tu n'es pas un idiot") == []
    assert score("She said: idiot.")[0] < 1.0 and sum(score('"You are an idiot," he said.')) < 2.0
    for t in ("I will kill you.", "Kill them all!", "We're gonna hurt your family", "You deserve to die", "Ich werde dich töten", "je vais te tuer", "te voy a matar", "kill all of you"):
        assert sum(score(t)) >= 2.0, t
    for t in ("You piece of trash", "du bist ein Arschloch", "tu es un connard", "eres un idiota, tú", "hijo de puta, idiota"):
        assert sum(score(t)) >= 2.0, t
    for t in ("They beat the market.", "you hunt for your keys", "They kill time. A fine day.", "I won't kill you", "ich werde dich nicht töten", "The weather is fine.", "You burn wood", "we beat you at chess"):
        assert sum(score(t)) < 2.0, t
    assert sum(score("He said he will kill you.")) < 2.0
    rng = random.Random(3)
    vocab = "idiot scum kill hurt you they not said the a day , . fine never he will all of your family dich but töten".split()
    for _ in range(3000):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 25)))
        assert score(t) == brute_score(t), t


def test_toxicity_takes_long_words(spark):
    rng, rows, labels = random.Random(1), [], []
    for i in range(60):
        w = words(rng, 40).split()
        for _ in range(3 * (i % 3 == 0)):
            w.insert(rng.randrange(40), "un" * 7 + "schimpfwort")
        w += ["un" * 7 + "auffällig"] * 2
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    docs, labels = table(spark, rows), labels_of(spark, labels)
    found = toxicity.learn_stems(docs, labels)
    assert "un" * 7 + "schimpfwort$" in found and not any(x.startswith("un" * 7 + "a") for x in found)


def test_toxicity_learns_stems_and_filters(spark):
    rng, rows, labels = random.Random(1), [], []
    for i in range(60):
        bad = i % 3 == 0
        w = words(rng, 40).split()
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(40), "blurk" + rng.choice(["a", "en", "ish", "ung", "or"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs, labels = table(spark, rows), labels_of(spark, labels)
    stems = toxicity.learn_stems(docs, labels)
    assert any("blurk".startswith(x.rstrip("$")) or x.startswith("blurk") for x in stems)
    kept = {r.doc_id for r in toxicity.reject_toxic(spark, docs, labels).collect()}
    assert kept == {i for i in range(60) if i % 3}
    assert toxicity.reject_toxic(spark, docs, None).columns == docs.columns


# --- tokens -----------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return unigram.Unigram(unigram.vocabulary())


def reference():
    """The same unigram model in another library."""
    import sentencepiece
    from tokenizers import Tokenizer, models

    sp = sentencepiece.SentencePieceProcessor(model_file=unigram.MODEL)
    normal = {i for _, _, i in unigram.vocabulary()["pieces"]}
    named = [(sp.id_to_piece(i), sp.get_score(i) if i in normal else -2e9) if i in normal or sp.is_byte(i) else (f"\x01{i}", -2e9) for i in range(sp.get_piece_size())]
    return Tokenizer(models.Unigram(named, 0, True))


TEXTS = ["the cat sat", "a  b   c", "  x", "é\n\n日本語 ☃☃ x▁y", "\n", " ", "a ", "Straße naïve 12345 — “q”", "x" * 300, "ab " * 200, "日本語" * 50]


def test_encoding_agrees_with_another_library(spark, model):
    other = reference()
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abcdethr  \n.,é☃") for _ in range(rng.randrange(1, 200))) for _ in range(200)]
    want = [other.encode("▁" + t.replace(" ", "▁")).ids for t in texts]
    docs = table(spark, list(enumerate(texts)))
    for size in (65_536, 7, 40):
        got = {r.doc_id: r for r in sentencepiece_scan.encode(docs, chunk_chars=size).collect()}
        for i, w in enumerate(want):
            assert list(got[i].ids) == w, (size, texts[i])
            assert got[i].round_trip and got[i].n_tokens == len(w)
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    assert counts == {i: len(w) for i, w in enumerate(want)}
    back = {r.doc_id: r.text for r in sentencepiece_scan.decode(sentencepiece_scan.encode(docs)).collect()}
    assert back == {i: t.replace("▁", " ") for i, t in enumerate(texts)}


def test_encoding_of_long_texts(spark, model):
    """Texts over 65,536 characters, with the default settings: words, one run of letters, blanks, and a repeated row."""
    other, rng = reference(), random.Random(9)
    texts = [words(rng, 30_000), "ab" * 50_000, " " * 70_000 + "x", "日本語 " * 30_000]
    docs = table(spark, list(enumerate(texts)) + [(0, texts[0])])
    got = sentencepiece_scan.encode(docs).collect()
    assert sorted(r.doc_id for r in got) == [0, 0, 1, 2, 3]
    for r in got:
        assert list(r.ids) == other.encode("▁" + texts[r.doc_id].replace(" ", "▁")).ids and r.round_trip
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    assert counts == {r.doc_id: r.n_tokens for r in got}
    nulls = spark.createDataFrame([(1, None), (None, [5]), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text is None for r in sentencepiece_scan.decode(nulls).collect()} == {1: True, None: False, 2: False}


def test_scan_is_associative(model):
    rng = np.random.default_rng(0)
    ms = [np.where(rng.random((4, 4)) < 0.3, -1e300, rng.integers(-9, 0, (4, 4)).astype(float)) for _ in range(6)]
    got = sentencepiece_scan.scan(ms)
    v = np.full(4, -1e300)
    v[0] = 0.0
    for m, g in zip(ms, got):
        assert np.array_equal(v, g)
        v = sentencepiece_scan.times(v[None, :], m)[0]


# --- mixing -----------------------------------------------------------------


def test_knapsack_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 5)
        size = sorted(rng.sample(range(1, 12), n))
        left = [rng.randrange(0, 4) for _ in size]
        goal = rng.randrange(0, 40)
        got = mixing.knapsack(size, left, goal)
        assert all(k <= left[i] for i, k in got)
        best = max(s for s in (sum(a * b for a, b in zip(size, c)) for c in itertools.product(*[range(x + 1) for x in left])) if s <= goal)
        assert sum(size[i] * k for i, k in got) == best


def test_fitted_counts_are_the_best():
    rng = random.Random(6)
    assert sum(a * b for a, b in zip((5000, 7001), mixing.fit_counts([5000, 7001], [5, 3], 15_000))) == 15_000
    for turn in range(300):
        n, big = rng.randrange(1, 5), rng.choice((12, 60, 6000))
        size = rng.sample(range(1, big), n)
        if turn % 3 == 0:
            size = [3 * x for x in size]
        left = [rng.randrange(0, 5) for _ in size]
        budget = rng.randrange(0, 4 * big)
        got = mixing.fit_counts(size, left, budget, window=rng.choice((8, 64, 4096)))
        assert all(0 <= k <= m for k, m in zip(got, left))
        best = max(s for s in (sum(a * b for a, b in zip(size, c)) for c in itertools.product(*[range(x + 1) for x in left])) if s <= budget)
        assert sum(a * b for a, b in zip(size, got)) == best


def test_mixing_meets_budgets(spark, model):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(1, 60)), rng.choice("aaab") if i % 9 else None) for i in range(400)]
    rows += [(500, words(rng, 20), "a")] * 40 + [(501, "日本語" * 30, "b"), (502, "", "c"), (503, None, "b")]
    docs = table(spark, rows)
    count = lambda t: sum(map(unigram.Counts(model).__getitem__, model.units(t)))
    got = mixing.mix_sources(docs, {"a": 0.5, "b": 0.5}).collect()
    by = {}
    for r in got:
        if r.text:
            by[r.source] = by.get(r.source, 0) + count(r.text)
    have = {s: sum(count(t) for _, t, x in rows if x == s and t) for s in "ab"}
    assert by == {"a": min(have.values()), "b": min(have.values())}
    assert {502, 503} <= {r.doc_id for r in got}
    assert mixing.mix_sources(docs, alpha=1.0).count() == 443
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in mixing.mix_sources(docs.repartition(7), {"a": 0.5, "b": 0.5}).collect())
    for small in range(60, 400, 97):  # budgets that end among the copies
        got = mixing.mix_sources(docs, {"a": 1.0}, total=small).collect()
        assert sum(count(r.text) for r in got if r.text) == small


def test_tokens_counted_by_the_batch_are_those_of_each_text():
    """Units come from whole batches; a word that comes once is not remembered, nor is a full stop counted with each word anew."""
    rng = random.Random(97)
    plain = ["".join(rng.choice("aehinorstéß日") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    ends = ["", "", ",", ".", "...", "?!", "%", "\U0001f600", '."']
    texts = [rng.choice([" ", " ", " ", "\n", "\n\n"]).join(rng.choice(plain) + rng.choice(ends) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    texts += ["", None, " a b", "a  b", "a ", "a\nb ", "\n", ".", " ", "▁a b▁", "x\n\ny."]
    u = unigram.Unigram(unigram.vocabulary())
    want = [sum(map(u.count, u.units(t))) if t else 0 for t in texts]
    for most, size in ((300_000, 4_000_000), (5, 300)):
        assert token_counts.count_tokens(pa.array(texts, pa.string()), u, unigram.Counts(u, most), size).tolist() == want
    asked, once, count = [], "some word here some word. here once", u.count
    u.count = lambda unit: asked.append(unit) or count(unit)
    counts = unigram.Counts(u)
    token_counts.count_tokens(pa.array([once]), u, counts)
    assert asked.count("▁some") == 1 and "▁word." not in asked
    assert "▁some" in counts and "▁once" not in counts


def test_mixing_is_not_bound_by_the_smallest_source():
    def shares(tokens, **more):
        return mixing.budgets(tokens, {s: t**0.5 for s, t in tokens.items()}, **more)

    even = {f"s{i}": 200_000 + i for i in range(20)}
    tiny = shares(even | {"": 100})
    assert tiny[""] == 100 and sum(tiny.values()) >= 0.95 * sum(even.values())
    hot = even | {"hot": 10_000_000}
    assert all(shares(hot)[s] >= 0.99 * t for s, t in even.items())
    whole = shares(hot | {"": 100}, total=12_000_000)
    assert sum(whole.values()) == 12_000_000 and whole[""] == 100 and all(whole[s] == t for s, t in even.items())
    assert shares(hot, total=10**9) == hot
    assert mixing.budgets(hot, hot) == hot


# --- duplicates -------------------------------------------------------------


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(999)}" if rng.random() < share else w for w in text.split())


def corpus(seed=7, groups=25):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = words(rng, rng.randrange(30, 300), 5000)
        for text in [base, base, edited(rng, base, 0.03), edited(rng, base, 0.05)][: rng.randrange(1, 5)]:
            rows.append((len(rows), text))
    return rows


def linked(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    made = {}
    for i in range(n):
        made.setdefault(find(i), set()).add(i)
    return {frozenset(x) for x in made.values() if len(x) > 1}


def grouped(rows):
    made = {}
    for r in rows:
        made.setdefault(r.group_id, set()).add(r.doc_id)
    return {frozenset(x) for x in made.values()}


def near_sets(rows, containment=0.5, min_ratio=0.7, least=20):
    """Groups of op3 by comparing all with all; one threshold for all ratios of size, and every document of a group is looked for in larger ones."""
    sets = [set(minhash.shingles(t).tolist()) for _, t in rows]
    near = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        lo, hi = sorted((len(sets[a]), len(sets[b])))
        if lo and len(sets[a] & sets[b]) >= containment * lo and lo >= min_ratio * hi:
            near.append((a, b))
    group = {i: i for i in range(len(rows))}
    for g in linked(len(rows), near):
        group.update(dict.fromkeys(g, min(g)))
    more = []
    for g in set(group.values()):
        held = [(q, x) for q in group if group[q] == g and len(sets[q]) >= least for x in group if group[x] != g and len(sets[q]) < min_ratio * len(sets[x]) and len(sets[q] & sets[x]) >= containment * len(sets[q])]
        if held:
            more.append(max(held, key=lambda p: len(sets[p[1]])))
    return near, more, linked(len(rows), near + more)


def test_minhash_against_brute_force(spark):
    rows = corpus() + [(900 + i, "only two words" if i else "only two") for i in range(3)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    near, more, want = near_sets(rows)
    docs = table(spark, rows + [rows[0]])
    got = minhash.near_duplicates(docs).collect()
    assert len(want & grouped(got)) >= 0.9 * len(want)
    assert all(any(g <= w for w in want) for g in grouped(got))
    kept = [r.doc_id for r in minhash.one_of_each(docs).collect()]
    assert len(kept) == len(set(kept))
    for g in grouped(got):
        assert len(g & set(kept)) == 1
    assert set(range(len(rows))) - set().union(*grouped(got)) <= set(kept)


@pytest.mark.parametrize("filtered", [True, False])
def test_minhash_finds_short_texts_inside_long_ones(spark, monkeypatch, filtered):
    """Sizes of every ratio up to 60; a passage that two long texts share does not make them one group."""
    if not filtered:
        monkeypatch.setattr(minhash, "FILTER_PROBES", 0)
    rng, rows = random.Random(53), []
    for k in range(60):
        w = words(rng, 30 + rng.randrange(60), 9000)
        rows.append((2 * k, w))
        rows.append((2 * k + 1, f"{words(rng, 60 * rng.randrange(1, 30), 9000)} {edited(rng, w, 0.02)} {words(rng, 40, 9000)}"))
    shared = words(rng, 60, 9000)
    rows += [(120, shared), (121, f"{shared} {words(rng, 300, 9000)}"), (122, f"{words(rng, 400, 9000)} {shared}")]
    near, more, want = near_sets(rows)
    got = grouped(minhash.near_duplicates(table(spark, rows)).collect())
    assert not near and len(more) >= 50
    assert len(want & got) >= 0.95 * len(want) and all(any(g <= w for w in want) for g in got)
    assert frozenset({120, 122}) in got
    kept = {r.doc_id for r in minhash.one_of_each(table(spark, rows)).collect()}
    assert {121, 122} <= kept and 120 not in kept and all(2 * k + 1 in kept for k in range(60))


def partly_inside(rng):
    """Texts of 30 to 150 words, two thirds of each in a text of several times its size, and pairs of copies only the shorter of which is in a third one."""
    rows = []
    for k in range(40):
        w = words(rng, 30 + 3 * k, 90000).split()
        at = 2 * len(w) // 3 + 2
        rows.append((2 * k, " ".join(w)))
        rows.append((2 * k + 1, f"{words(rng, 150, 90000)} {' '.join(w[:at])} {words(rng, 100 + 10 * k, 90000)}"))
    for k in range(80, 110, 3):
        short, tail = words(rng, 100, 90000), words(rng, 35, 90000).split()
        rows.append((k, f"{short} {' '.join(tail)}"))
        rows.append((k + 1, short))
        rows.append((k + 2, f"{words(rng, 200, 90000)} {' '.join(short.split()[:62])} {words(rng, 100, 90000)}"))
    return rows


def test_minhash_links_unlike_sizes_at_the_same_threshold(spark):
    rows = partly_inside(random.Random(59))
    near, more, want = near_sets(rows)
    assert len(near) == 10 and len(more) >= 50
    got = grouped(minhash.near_duplicates(table(spark, rows)).collect())
    assert len(want & got) >= 0.9 * len(want) and all(any(g <= w for w in want) for g in got)


def test_minhash_links_texts_of_few_words_and_counts_links(spark):
    """Texts of 5 to 23 words whole and in part in several long ones; every link of unlike sizes is counted at its smaller end."""
    rng, rows = random.Random(73), []
    for n in range(5, 24):
        w = words(rng, n, 90000)
        rows.append((len(rows), w))
        for k in range(1 + n % 3):
            part = " ".join(w.split()[: max(5, (n + 8) // 2)]) if k else w
            rows.append((len(rows), f"{words(rng, 40 + 30 * k, 90000)} {part} {words(rng, 50, 90000)}"))
    rows.append((len(rows), " ".join(rows[0][1].split()[:3])))
    near, more, want = near_sets(rows, least=1)
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert not near and len(more) == 19 and grouped(got) == want
    sets = [set(minhash.shingles(t).tolist()) for _, t in rows]
    inside = {i: sum(len(s) < 0.7 * len(x) and 2 * len(s & x) >= len(s) for x in sets) for i, s in enumerate(sets)}
    assert {r.doc_id: r.inside for r in got} == {r.doc_id: inside[r.doc_id] for r in got} and sum(inside.values()) == sum(r.inside for r in got) > 30
    assert len(minhash.one_of_each(table(spark, rows)).collect()) == len(rows) - 19


def test_buckets_with_the_same_members_are_kept_once(spark, monkeypatch):
    rng, rows, cut, seen = random.Random(67), [], common.cut, []
    for k in range(20):
        w = words(rng, 300, 90000)
        rows += [(2 * k, w), (2 * k + 1, f"{w} {words(rng, 1, 90000)}")]

    def spy(df):
        made = cut(df)
        seen.extend([made.count()] * ("bucket" in made.columns))
        return made

    monkeypatch.setattr(common, "cut", spy)
    got = grouped(minhash.near_duplicates(table(spark, rows)).collect())
    assert got == {frozenset({2 * k, 2 * k + 1}) for k in range(20)} and seen[0] <= 3 * len(rows)


def test_scattered_members_meet():
    rng = np.random.default_rng(71)
    keys, buckets = rng.integers(-(1 << 62), 1 << 62, 400), rng.integers(0, 1 << 63, 60, dtype=np.uint64) << np.uint64(1)
    k, b = keys[rng.integers(0, 400, 300)], buckets[rng.integers(0, 60, 300)]
    members = {frozenset(k[b == x].tolist()) for x in buckets}
    got = {}
    for batch in common.met([common.scattered(k[:200], b[:200], 7), common.scattered(k[200:], b[200:], 7), common.scattered(k[:0], b[:0], 7)]):
        for name, key, first in zip(*(c.to_pylist() for c in batch.columns)):
            got.setdefault((name, first), []).append(key)
    assert sorted(map(sorted, got.values())) == sorted(sorted(m) for m in members if len(m) > 1) and all(f == min(m) for (_, f), m in got.items())
    parts = [p for batch in [common.scattered(k, b, 7)] for p in batch.column(0).to_pylist()]
    assert parts == sorted(set(parts)) and max(parts) < 7


def test_blobs_become_one_table():
    rows = np.random.default_rng(79).integers(0, 1 << 32, (9, minhash.SKETCH), dtype=np.uint32)
    blobs = pa.array([r.tobytes() for r in rows], pa.binary())
    assert (minhash.table_of(pa.chunked_array([blobs[:2], blobs[2:2], blobs[2:5], blobs[5:]]), np.uint32) == rows).all()


def test_packed_sets():
    s = np.unique(np.random.default_rng(3).integers(0, 1 << 40, 500, dtype=np.uint64))
    assert (minhash.unpacked(minhash.packed(s)) == s).all() and (minhash.unpacked(minhash.packed(s), 48) == s[:48]).all() and len(minhash.packed(s)) == 5 * len(s)


def test_minhash_finds_pairs_at_the_threshold():
    import inspect

    p = {k: v.default for k, v in inspect.signature(minhash.near_groups).parameters.items() if k != "docs"}
    assert p["recall"] >= 0.9
    rng, plan = np.random.default_rng(41), minhash.banding(p["containment"], p["min_ratio"], p["recall"])
    for lo, hi in ((140, 200), (150, 200), (200, 200)):
        at = int(np.log(hi) / np.log(minhash.GROWTH) + 1e-9) - int(np.log(lo) / np.log(minhash.GROWTH) + 1e-9)
        rows, bands = plan[at]
        hits = 0
        for _ in range(300):
            s = rng.integers(0, 1 << 63, hi + lo - lo // 2, dtype=np.uint64)
            a, b = (minhash.signature(x)[: rows * bands].reshape(bands, rows) for x in (s[:hi], s[hi - lo // 2 :]))
            hits += bool((a == b).all(axis=1).any())
        assert hits >= 0.87 * 300, (lo, hi, hits)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_and_groups(spark):
    rng = random.Random(11)
    for _ in range(200):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 25)))
        b = "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 25)))
        assert edit_embedding.edit_distance(a, b) == distance(a, b)
    for size in (4100, 6000):
        a = "".join(rng.choice("abcdefgh ") for _ in range(size))
        b = "".join(c for c in a if rng.random() > 0.01) + "xyz"
        full = edit_embedding.edit_distance(a, b)
        quick = edit_embedding._by_diagonals
        edit_embedding._by_diagonals = lambda *_: None
        assert full == edit_embedding.edit_distance(a, b) and quick(a, b) == full
        edit_embedding._by_diagonals = quick
    rows = corpus(13)
    near = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if edit_embedding.edit_distance(a[1], b[1]) <= 0.15 * max(len(a[1]), len(b[1]))]
    want = linked(len(rows), near)
    got = edit_embedding.edit_groups(table(spark, rows + [rows[0]])).collect()
    pairs = [(a, b) for a, b in near if any(a in g and b in g for g in grouped(got))]
    assert len(pairs) >= 0.9 * len(near)
    assert all(any(g <= w for w in want) for g in grouped(got))
    texts = dict(rows)
    assert all(r.distance == edit_embedding.edit_distance(texts[r.doc_id], texts[r.group_id]) for r in got)


def test_edit_groups_leave_no_texts_on_disk(spark, monkeypatch):
    made, cut = [], edit_embedding.cut

    def spy(df):
        made.append(cut(df))
        return made[-1]

    monkeypatch.setattr(edit_embedding, "cut", spy)
    assert edit_embedding.edit_groups(table(spark, corpus(11, 8))).count() > 0
    held = [df for df in made if {"text", "buckets"} & set(df.columns)]
    assert len(held) >= 3 and not any(Path(df._tw_path.removeprefix("file:")).exists() for df in held)


def test_edit_filter_is_a_lower_bound():
    rng = random.Random(59)
    for _ in range(200):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 300)))
        b = scattered(rng, a, rng.uniform(0, 0.5), rng.random() < 0.5)
        k = edit_embedding.edit_distance(a, b)
        assert not edit_embedding.few_in_common(a, b, k)
    a, b = words(rng, 200, 9000), words(rng, 200, 9000)
    assert edit_embedding.few_in_common(a, "x" * len(a), len(a) // 7) and edit_embedding.edit_distance(a, b) > 0


def test_edit_distances_of_many_pairs():
    rng, pairs = random.Random(71), [("", "abc"), ("abc", ""), ("abc", "abc"), ("x" * 900, "y" * 950), ("日本語" * 9, "日本" * 12), ("\U0001f600a", "b\U0001f600")]
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh é") for _ in range(rng.choice((3, 30, 300, 2000))))
        pairs.append((a, scattered(rng, a, rng.choice((0.0, 0.01, 0.05, 0.15, 0.4)), rng.random() < 0.5)))
    wide = "".join(chr(300 + rng.randrange(900)) for _ in range(500))
    pairs.append((wide, wide[:100] + "zz" + wide[130:]))
    want = [edit_embedding.edit_distance(a, b) for a, b in pairs]
    full = [max(len(a), len(b)) for a, b in pairs]
    assert edit_embedding.edit_distances(pairs, full) == want
    assert edit_embedding.edit_distances(pairs, full, together=7, most=40) == want
    some = [int(0.15 * x) for x in full]
    for got, x, z in zip(edit_embedding.edit_distances(pairs, some), want, some):
        assert got == x if x <= z else got > z


def test_edit_groups_of_long_texts_and_shared_passages(spark):
    """A text over 65,536 characters with a near copy; many texts that share a passage are no group."""
    rng, passage = random.Random(61), words(random.Random(67), 60, 9000)
    long = words(rng, 16_000, 9000)
    rows = [(0, long), (1, edited(rng, long, 0.01)), (2, long[:66_000])]
    rows += [(i, f"{words(rng, 120, 9000)} {passage} {words(rng, 120, 9000)}") for i in range(3, 60)]
    base = words(rng, 150, 9000)
    rows += [(i, edited(rng, base, 0.02)) for i in range(60, 120)]
    got = grouped(edit_embedding.edit_groups(table(spark, rows)).collect())
    assert got == {frozenset({0, 1}), frozenset(range(60, 120))}


def scattered(rng, text, share, by_words):
    """The text with about ``share`` of its characters edited, in words or one by one."""
    if by_words:
        return " ".join("".join(rng.choice("abcdefghij") for _ in w) if rng.random() < share else w for w in text.split())
    return "".join(rng.choice(["", rng.choice("abcdefghij"), c + rng.choice("abcdefghij")]) if rng.random() < share else c for c in text)


@pytest.mark.parametrize("by_words", [False, True])
@pytest.mark.parametrize("n", [12, 20, 40, 150, 400])
def test_edit_candidates_up_to_the_limit(n, by_words):
    rng, found, high = random.Random(37), [], []
    while len(high) < 100:
        a = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(n))
        b = scattered(rng, a, rng.uniform(0, 0.2), by_words)
        share = edit_embedding.edit_distance(a, b) / max(len(a), len(b))
        if 0 < share <= 0.15:
            ids, h, sigs = edit_embedding.fingerprints([a, b], 12, 2)
            x, y = (np.frombuffer(v, np.uint8)[None, :] for v in sigs)
            hit = bool(set(h[ids == 0].tolist()) & set(h[ids == 1].tolist())) and bool(edit_embedding.close(0.15)(x, y)[0])
            found.append(hit)
            if share > 0.1:
                high.append(hit)
    assert np.mean(found) >= 0.9
    assert np.mean(high) >= 0.9


def test_texts_that_share_a_line_are_told_apart_by_signature():
    """Near copies at the limit pass the sieve, also around a stretch taken out; texts that merely share a line do not."""
    rng = random.Random(83)
    some = ["".join(rng.choice("aehinorst") for _ in range(rng.randrange(2, 9))) for _ in range(150)]

    def prose(n):
        return " ".join(rng.choice(some) for _ in range(n))

    def passing(pairs):
        x, y = ([edit_embedding.signature(edit_embedding.symbols(p[i]).astype(np.uint64)) for p in pairs] for i in (0, 1))
        return edit_embedding.close(0.15)(*(np.array([np.frombuffer(v, np.uint8) for v in z]) for z in (x, y))).mean()

    line, bases = prose(14), [prose(n) for n in (80, 120, 200, 350) for _ in range(40)]
    assert passing([(f"{line}\n{a}", f"{line}\n{prose(len(a.split()))}") for a in bases]) < 0.1
    assert passing([(a, scattered(rng, a, 0.14, False)) for a in bases]) >= 0.97
    assert passing([(a, a[: (at := rng.randrange(len(a) * 6 // 7))] + a[at + len(a) // 7 :]) for a in bases]) == 1


def test_edit_distances_on_both_sides_of_the_longest_text_for_arrays():
    rng, pairs = random.Random(89), []
    for n, cut_ in ((95, 0), (101, 20), (99, 3), (120, 40), (90, 30), (104, 1)):
        a = "".join(rng.choice("abcd") for _ in range(n))
        pairs.append((a, scattered(rng, a, 0.4, False)[cut_:]))
    got = edit_embedding.edit_distances(pairs, [max(map(len, p)) for p in pairs], alone=100, few=2)
    assert got == [edit_embedding.edit_distance(*p) for p in pairs]


def repeats(rows, least):
    """Marked words by (doc_id, kind), by counting windows."""
    rows = sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    texts = [[w.lower() for w in minhash.word_hashes.__globals__["WORD"].findall(t)] for _, t in rows]
    seen = {}
    for d, w in enumerate(texts):
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), set()).add(d)
    made = {}
    for d, w in enumerate(texts):
        for i in range(len(w) - least + 1):
            s = seen[tuple(w[i : i + least])]
            if len(s) > 1:
                made.setdefault((rows[d][0], "repeat"), set()).update(range(i, i + least))
                if min(s) < d:
                    made.setdefault((rows[d][0], "copy"), set()).update(range(i, i + least))
    return made


@pytest.mark.parametrize("find", [runs.run_repeats, blocks.block_repeats, "shuffled"])
def test_repeats_against_brute_force(spark, find, monkeypatch):
    if find == "shuffled":  # the way beyond the broadcast bound
        monkeypatch.setattr(runs, "BROADCAST_ROWS", 0)
        find = runs.run_repeats
    rng = random.Random(17)
    passage = [words(rng, n, 5000) for n in (50, 51, 80, 49)]
    rows = [(i, words(rng, rng.randrange(0, 80), 5000) + " " + rng.choice(passage + [""]) + " " + words(rng, rng.randrange(0, 60), 5000)) for i in range(60)]
    rows += [(i, rows[2][1]) for i in range(70, 90)] + [(-1, rows[4][1]), (None, rows[4][1])]
    long = words(rng, 15_000, 5000)
    rows += [(90, f"{long} {passage[2]}"), (91, f"x {long[4000:90_000]} y")]
    rows += [(60, rows[0][1]), (61, words(rng, 60, 3) + " x"), (62, "lo la " * 70), (63, "lo la " * 50), (64, rows[1][1].upper().replace(" ", ", "))]
    got = {}
    docs = table(spark, rows + [rows[5], rows[62]])
    for r in find(docs).collect():
        assert r.end - r.start >= 50
        got.setdefault((r.doc_id, r.kind), set()).update(range(r.start, r.end))
    assert got == repeats(rows, 50)


def test_cut_copies(spark):
    rng = random.Random(19)
    p = words(rng, 60, 5000)
    docs = table(spark, [(1, f"Alpha. {p}. Omega."), (2, f"Beta, {p}! End."), (3, p), (4, None), (3, p)])
    got = sorted(((r.doc_id, r.text) for r in runs.cut_copies(spark, docs).collect()), key=str)
    assert got == sorted([(1, f"Alpha. {p}. Omega."), (2, "Beta, End."), (3, ""), (3, ""), (4, None)], key=str)


def test_run_index_against_brute_force():
    rng = np.random.default_rng(23)
    for _ in range(20):
        parts = [rng.integers(0, 3, rng.integers(1, 30)) for _ in range(rng.integers(2, 8))]
        index = runs.RunIndex(parts)
        ms = index.stream()[0]
        for i, p in enumerate(parts):
            for t in range(len(p)):
                best = 0
                for j, q in enumerate(parts):
                    for u in range(len(q)):
                        if (i, t) != (j, u):
                            k = 0
                            while t + k < len(p) and u + k < len(q) and p[t + k] == q[u + k]:
                                k += 1
                            best = max(best, k)
                assert ms[index.offsets[i] + t] == best


# --- embeddings, quality ----------------------------------------------------


def test_graph_recall_and_verification(spark):
    rng = np.random.default_rng(29)
    x = rng.normal(size=(900, 16))
    x[300:600] = x[:300] + rng.normal(size=(300, 16)) * 0.05
    x[600:700] = x[0] + rng.normal(size=(100, 16)) * 0.03
    x[700:760] = x[1]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (None, rows[0][1]), (5003, [1.0, 2.0]), rows[3], (5004, [float("nan")] * 16)]
    e = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<double>, v string, links int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)))}
    group = {i: min(g) for g in linked(900, true) for i in g}
    for shard in (300, 60):
        got = {r.vec_id: r for r in graph.near_vectors(e, shard=shard).collect()}
        assert set(got) == set(range(900)) | {5003} and got[5003].links == 0
        assert sum(got[i].links for i in range(900)) >= 0.99 * 2 * len(true)
        assert all(got[i].links <= near[i].sum() - 1 for i in range(900))
        assert sum(got[i].group_id == group.get(i, i) for i in range(900)) >= 890
    assert graph.near_vectors(e.limit(0)).count() == 0


def test_graph_search_crosses_shards(spark):
    """Pairs at a cosine just above the threshold, over many small shards, the audit off."""
    rng = np.random.default_rng(43)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(1500, 32))
    side -= (side * x[:1500]).sum(axis=1, keepdims=True) * x[:1500]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x[1500:] = 0.955 * x[:1500] + (1 - 0.955**2) ** 0.5 * side
    e = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.group_id for r in graph.near_vectors(e, shard=150, audited=0).collect()}
    assert sum(got[i + 1500] == got[i] for i in range(1500)) >= 0.93 * 1500
    classes = e.selectExpr("vec_id", "32 dims", "embedding v")
    points = classes.select("vec_id", "v")
    pairs = graph.near_pairs(classes, shard=150, probes=1, beam=4)
    assert graph.audit_points(points, pairs, 0.95, 256) >= 0.95


def test_centres_in_two_levels():
    rng = np.random.default_rng(5)
    c, x = rng.normal(size=(300, 8)), rng.normal(size=(200, 8))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    flat, deep = graph.Centres(c).nearest(x, 3), graph.Centres(c, flat=10).nearest(x, 3)
    assert np.mean(flat == deep) >= 0.9


def test_quality_on_held_out_rows(spark):
    rng, rows, labels = random.Random(31), [], []
    for i in range(500):
        good = i % 2
        w = words(rng, 60)
        rows.append((i, w.capitalize() + "." if good else w.upper().replace(" ", "!! ")))
        labels.append((i, good, 0))
    docs = table(spark, rows)
    got = {r.doc_id: r for r in quality.quality(docs, labels_of(spark, labels[:300]), rows=1024, dims=32).collect()}
    assert sum(got[i].keep == bool(i % 2) for i in range(300, 500)) >= 195
    none = quality.quality(docs, labels_of(spark)).select("p_quality").distinct().collect()
    assert [round(r.p_quality, 6) for r in none] == [0.5]


def test_context_vectors_by_hand():
    index = np.vstack([np.eye(4, dtype=np.int8), np.zeros((1, 4), np.int8)])
    total = np.zeros((5, 4), np.int32)
    quality.contexts([np.array([0, 1, 2], np.int32), np.array([3], np.int32)], index, total, 1)
    assert total[:4].tolist() == [[0, 1, 0, 0], [1, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]]


def components_by_hand(pairs):
    root = {x: x for p in pairs for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {(x, top(x)) for x in root}


def test_few_edges_are_joined_by_one_task_and_many_by_rounds(spark, monkeypatch):
    rng = random.Random(3)
    # negative keys, repeated and turned edges, a path whose keys go up and down, and pairs of one key with itself
    pairs = [(rng.randrange(-900, 900), rng.randrange(-900, 900)) for _ in range(700)]
    path = [x for n in range(60) for x in (5000 + n, 9000 - n)]
    pairs += [(b, a) for a, b in pairs[:50]] + list(zip(path, path[1:]))
    edges = spark.createDataFrame(pairs + [(7777, 7777)], "a long, b long")
    want, jobs = components_by_hand([p for p in pairs if p[0] != p[1]]), {}
    for most in (common.EDGES, 0):
        monkeypatch.setattr(common, "EDGES", most)
        spark.sparkContext.setJobGroup(f"edges{most}", "")
        got = [tuple(r) for r in common.components(edges).select(common.KEY, "comp").collect()]
        jobs[most] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"edges{most}"))
        assert len(got) == len(want) and set(got) == want
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] > 15 and min(jobs.values()) <= 6, jobs
    assert common.components(edges.limit(0)).count() == 0


def test_sweep_gives_the_drivers_free_memory_back(spark):
    common.sweep(spark)
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def held():
        return sum(int(x.split()[1]) for x in Path(f"/proc/{pid}/smaps_rollup").read_text().splitlines() if x.startswith("Anonymous:"))

    unsafe = spark._jvm.org.apache.spark.unsafe.Platform
    blocks_ = [unsafe.allocateMemory(64_000) for _ in range(1600)]
    for b in blocks_:
        unsafe.setMemory(b, 1, 64_000)
    for b in blocks_[:-1]:  # the last one keeps the heap's end where it is
        unsafe.freeMemory(b)
    before = held()
    common.sweep(spark)
    assert held() < before - 50_000  # KB
    unsafe.freeMemory(blocks_[-1])


def test_signatures_are_compared_only_where_lengths_leave_it_open(monkeypatch):
    rng, asked = random.Random(4), []
    texts = [words(rng, n, 60) for n in (5, 20, 60, 61, 64, 300, 310, 900, 905) for _ in range(4)]
    texts += [t[:-40] + words(rng, 6, 60) for t in texts if len(t) > 200]
    sigs = np.frombuffer(b"".join(edit_embedding.signature(edit_embedding.symbols(t).astype(np.uint64)) for t in texts), np.uint8).reshape(len(texts), -1)
    a, b = np.array(list(itertools.combinations(range(len(texts)), 2))).T
    count = edit_embedding.ones
    monkeypatch.setattr(edit_embedding, "ones", lambda m, k: asked.append(len(m)) or count(m, k))
    got = edit_embedding.close(0.15)(sigs[a], sigs[b])
    size = np.array([len(t) for t in texts])
    lo, hi = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    want, at = hi - lo <= 0.15 * hi, 4
    like = int((want & (lo > 150)).sum())
    for _, cells, share, plain, stretches, most in edit_embedding.PARTS:
        x, y = sigs[a, at : at + cells], sigs[b, at : at + cells]
        both = np.minimum(((x == y) & (x > 0)).reshape(len(a), stretches, -1).sum(axis=2), most).sum(axis=1)
        used = ((x > 0) | (y > 0)).sum(axis=1)
        want &= (both >= share * used - 0.6 * np.sqrt(share * used)) | (lo <= plain)
        at += cells
    assert got.tolist() == want.tolist() and 0 < want.sum() < like
    assert asked[0] == like < len(a) and asked[-1] < like


def test_members_of_a_bucket_whose_first_is_far_from_them_are_joined(spark):
    # 1 is the first of its bucket and near none; 2 to 6 are near each other as (2, 3) and (4, 5, 6); 8 and 9 share a bucket and are apart
    keys, buckets = np.array([1, 2, 3, 4, 5, 6, 8, 9, 1, 4, 5, 6]), np.array([1, 1, 1, 1, 1, 1, 2, 2, 3, 3, 3, 3], np.uint64) << np.uint64(60)
    near = {(2, 3), (4, 5), (5, 6), (4, 6)}
    made = common.scattered(keys, buckets, common.ranges(spark))
    rows = spark.createDataFrame(pa.Table.from_batches([made]).to_pylist(), common.SCATTERED)
    sigs = spark.createDataFrame([(k, bytes([k])) for k in range(1, 10)], "__key long, sig binary")
    compared = spark.sparkContext.accumulator(0)

    def close(x, y):
        compared.add(int((np.minimum(x[:, 0], y[:, 0]) == 1).sum()))
        return np.ones(len(x), bool)

    def verify(pairs):
        return pairs.filter(" or ".join(f"(a = {a} and b = {b})" for a, b in near))

    got = {tuple(r) for r in common.agreed(rows, verify, sigs, close).select(common.KEY, "comp").collect()}
    assert got == {(2, 2), (3, 2), (4, 4), (5, 4), (6, 4)}
    assert compared.value == 5  # as a star once each, and not again with all others
