import math
import random
import re

from parchment.llm import contamination as C
from parchment.llm import language as L
from parchment.llm.automaton import SuffixAutomaton
from parchment.llm.language import TRAIN_DOCS, Parser, identify, training_sample, train
from parchment.llm.neighbours import link_vectors
from parchment.llm.toxicity import Restorer, score, suspicious

DOCS = "doc_id long, text string, lang string, source string"


def test_automaton_parse_against_search():
    r = random.Random(1)
    for _ in range(60):
        texts = ["".join(r.choice("abc") for _ in range(r.randrange(1, 12))) for _ in range(4)]
        auto = SuffixAutomaton(texts)
        s = "".join(r.choice("abcd") for _ in range(r.randrange(1, 20)))
        n = at = 0
        while at < len(s):
            k = max((k for k in range(1, len(s) - at + 1) if any(s[at : at + k] in t for t in texts)), default=1)
            at, n = at + k, n + 1
        assert auto.phrases(s) == n


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, window=13):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w, hit, found = WORDS.findall(low), set(), set()
    for item, t in items:
        v = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        k = min(window, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if v and tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(item)
    return len(w), len(hit), sorted(map(str, found))


def corpus(seed):
    r = random.Random(seed)
    words = ["a", "b", "c", "É1", "ß", "d9"]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 5, 13, 14, 20])))) for k in range(8)] + [(90, None), (91, "!!"), (92, "")]
    docs = [(k, r.choice([" ", ", ", "\n"]).join(r.choice(words + ["zz", "A", "B "]) for _ in range(r.randrange(60)))) for k in range(60)]
    return items, docs + [(100, None), (101, ""), (102, items[4][1] + " " + items[5][1]), (None, "a"), (103, "a " * 30000)]


def test_contamination_against_brute_force(spark):
    items, docs = corpus(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as items")
    found = C.hit_columns(C.scan_documents(frame, bench))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()), key=str) == sorted(((d, *brute_hits(t, items)) for d, t in docs), key=str)


def test_chunks_of_a_large_benchmark_are_united(spark, monkeypatch):
    items, docs = corpus(4)
    monkeypatch.setattr(C.item_chunks, "__defaults__", (20,))
    # every window of an item is in its chunk, and chunks are small
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(C.item_chunks(bench)[1]) > 1
    found = C.hit_columns(C.scan_documents(spark.createDataFrame(docs, "doc_id long, text string"), bench))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()), key=str) == sorted(((d, *brute_hits(t, items)) for d, t in docs), key=str)


def test_spans_are_cut_and_contaminated_documents_go(spark):
    item = " ".join(f"w{k}" for k in range(15))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"keep this, {item}! and that", "en", "s"), (2, "clean", "en", "s"), (3, None, "en", "s"), (4, "x " * 400 + item, "en", "s")], DOCS)
    cut = {r.doc_id: r.clean_text for r in C.remove_spans(C.hit_columns(C.scan_documents(docs, bench))).collect()}
    assert cut[1] == "keep this, ! and that" and cut[2] == "clean" and cut[3] is None and cut[4].endswith("w14")
    kept = C.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == docs.columns
    assert C.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == 4


def test_items_without_an_id_give_hits(spark):
    passage, other = (" ".join(f"{c}{k}" for k in range(15)) for c in "wx")
    bench = spark.createDataFrame([(None, passage), (None, "short one"), (3, other)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, f"{other} {passage}"), (3, "a short one"), (4, "clean")], "doc_id long, text string")
    found = {r.doc_id: (r.n_hit, list(r["items"])) for r in C.hit_columns(C.scan_documents(docs, bench)).collect()}
    assert found == {1: (15, []), 2: (30, ["3"]), 3: (2, []), 4: (0, [])}
    named = spark.createDataFrame([("q-1", passage), ("q-0", other)], "item_id string, text string")
    assert [list(r["items"]) for r in C.scan_documents(docs, named).orderBy("doc_id").collect()] == [["q-1"], ["q-0", "q-1"], [], []]


def test_language(spark):
    r = random.Random(2)
    voc = {"en": ["the", "thing", "other", "ation"], "de": ["der", "schaft", "ung", "für"], "fr": ["le", "eau", "tion", "été"]}
    rows = [(k, " ".join("".join(r.choice(voc[lang]) for _ in range(r.choice([1, 2]))) for _ in range(30)), lang, "s") for k, lang in enumerate(list(voc) * 60)]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "123 !?", "en", "s"), (None, "the other thing", None, "s"), (903, "x" * 100_000, None, "s")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'zz' as lang_pred")
    out = {r.doc_id: r for r in identify(docs).collect()}
    assert all(out[k].lang_pred == lang for k, _, lang, _ in rows[:180])
    assert {out[k].lang_pred for k in (900, 901, 902)} == {"und"} and out[None].lang_pred == "en"
    assert all(0 <= r.lang_score <= 1 for r in out.values())
    sample = training_sample(docs)
    assert len(sample) <= 3 * TRAIN_DOCS and not {t for _, t in sample} & {t for k, t, *_ in rows if k in out and out[k].held_out}
    assert {r.lang_pred for r in identify(docs, []).collect()} == {"und"}
    assert identify(spark.createDataFrame([], DOCS)).collect() == []
    assert Parser(train(sample)).predict(["the thing", None, "²", "Ⅷ ½"]) [0][0] == "en"
    assert [p for p in Parser(train(sample)).predict([None, "", "²", "Ⅷ ½"])] == [("und", 0.0)] * 4


def brute_language(sample, text):
    """Phrases by search in the sample, stretch by stretch; the language with the fewest bits."""
    x, letters = L.symbols(text)
    if not letters:
        return "und"
    rates = {}
    for lang, auto in train(sample).items():
        own = ["".join(map(chr, L.symbols(t)[0])) for s, t in sample if s == lang]
        n = 0
        for a in range(0, len(x), L.STRETCH):
            s, at = "".join(map(chr, x[a : a + L.STRETCH])), 0
            while at < len(s):
                k = 1
                while at + k < len(s) and any(s[at : at + k + 1] in t for t in own):
                    k += 1
                at, n = at + k, n + 1
        rates[lang] = n * math.log2(len(auto.next)) / letters
    return min(rates, key=lambda lang: (rates[lang], lang))


def test_language_against_brute_force(monkeypatch):
    """Phrases cross word ends; ties go to the first name; long texts are parsed in stretches."""
    monkeypatch.setattr(L, "STRETCH", 40)
    r = random.Random(5)
    word = lambda k: "".join(r.choice("abcdef" if k else "cdefgh") for _ in range(r.randrange(1, 6)))
    sample = [(f"l{k}", " ".join(word(k) for _ in range(40)).title()) for k in (0, 1, 1)] + [("same1", "qq rr"), ("same0", "qq rr")]
    texts = [r.choice([" ", ", ", "\n"]).join(word(r.randrange(2)) for _ in range(r.randrange(1, 60))) for _ in range(40)] + ["qq rr", "ÖÖ zz", "x1y2", "a", "日本語 abc"]
    assert [p[0] for p in Parser(train(sample)).predict(texts)] == [brute_language(sample, t) for t in texts]
    assert Parser(train(sample)).predict(["qq rr"])[0][0] == "same0"


def test_restorer_reads_lookalikes(spark):
    from parchment.llm.toxicity import trigram_counts

    text = "the idiot and the clown are here with other words of this kind " * 50
    restorer = Restorer([tuple(r) for r in trigram_counts(spark.createDataFrame([(text,), (None,)], "text string")).collect()])
    assert [restorer.word(w) for w in ("1d10t", "cl0wn", "iiidiooot", "i.d.i.o.t", "cl-o-wn")] == ["idiot", "clown", "idiot", "idiot", "clown"]
    assert suspicious("1d10t") and suspicious("idiooot") and not suspicious("idiot") and not suspicious("123")


def test_restored_words_against_exhaustive_search():
    """The Viterbi word is one of the cheapest of all ways to read a token."""
    from parchment.llm import toxicity as X

    r = random.Random(4)
    text = " ".join("".join(r.choice("abdilo") for _ in range(r.randrange(2, 6))) for _ in range(400))
    counts = {}
    k = [X._CLASS.get(c, 0) for c in f" {text} "]
    for a, b, c in zip(k, k[1:], k[2:]):
        g = (a * X._BASE + b) * X._BASE + c
        counts[g] = counts.get(g, 0) + 1
    restorer = Restorer(list(counts.items()))

    def ways(token, word, cost):
        if not token:
            yield word, cost
            return
        c, rest = token[0], token[1:]
        for x in [c] if c.isalpha() else X.LOOKALIKES.get(c, ""):
            extra = 0.0 if c.isalpha() else X.SWAP
            yield from ways(rest, word + x, cost + extra)
            if word and word[-1] == x:
                yield from ways(rest, word, cost + extra + X.REPEAT)
        if not c.isalpha():
            yield from ways(rest, word, cost + X.NOISE)

    def spelled(word):
        at = [0, 0, *(X._CLASS.get(c, X._OTHER) for c in word), 0]
        return sum(restorer.cost[a, b, c] for a, b, c in zip(at, at[1:], at[2:]))

    for _ in range(150):
        token = "".join(r.choice("abdil1!0.4") for _ in range(r.randrange(1, 7)))
        best = {}
        for word, cost in ways(token, "", 0.0):
            best[word] = min(best.get(word, 1e9), cost + spelled(word))
        assert best[restorer.word(token)] <= min(best.values()) + 1e-9, token


def test_any_blanks_between_letters_are_undone(spark):
    from parchment.llm.toxicity import Reader

    restorer = Restorer([])
    reader = Reader(restorer, {"idiot": 0.9})
    assert all(reader.score(t) > 0.8 for t in ("i d i o t", "x  i  d  i  o  t", "i\nd\ni\no\nt", "i\t d\t i o t")) and reader.score("i d") < 0.1


def test_columns_with_the_operators_own_names(spark):
    """Clashing columns are replaced or left out; rows stay."""
    from parchment.llm.chat import example_tools, format_tool_calls, turns_as_calls
    from parchment.llm.packing import pack_best_fit
    from parchment.llm.warc import round_trip

    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string").selectExpr("*", "'x' as toxicity", "1 as toxic", "2 as held_out", "'i' as ids", "7 as sequence_id", "'u' as uid", "3 as n_tokens")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    out = score(docs, labels)
    assert out.count() == 2 and len(set(out.columns)) == len(out.columns)
    assert sum(len(r.doc_ids) for r in pack_best_fit(docs).collect()) == 2
    pages = spark.createDataFrame([(1, "u", "<p>"), (2, "v", "<p>")], "page_id long, url string, html string").selectExpr("*", "1 as uid", "'d' as digest", "2 as first", "'x' as payload")
    assert sorted(r.record_type for r in round_trip(pages).collect()) == ["response", "revisit"]
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (None, 1, "assistant", "a"), (None, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    messages = turns_as_calls(turns).selectExpr("*", "1 as uid", "2 as at", "3 as position", "'l' as status")
    done = format_tool_calls(messages, example_tools(messages)).collect()
    assert sorted((str(r.conv_id), r.position, r.kind) for r in done) == [("1", 0, "call"), ("1", 1, "result"), ("None", 0, "call"), ("None", 1, "result")]


def test_toxicity(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "other", "words", "and", "more"]
    bad = ["idiot", "clown", "scum"]
    rows, labels = [], []
    for k in range(600):
        w = [r.choice(words) for _ in range(30)]
        toxic = k % 5 == 0
        if toxic:
            for b in r.sample(bad, r.choice([1, 2, 3])):
                w[r.randrange(30)] = b
        rows.append((k, " ".join(w), "en", "s"))
        labels.append((k, 1, int(toxic)))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "such an 1d10t here", "en", "s"), (903, "what a c l o w n it is", "en", "s"), (None, "fine", None, None), (904, "fine " * 20_000, "en", "s")]
    labels += [(0, 1, 1), (None, 1, 1), (3, 1, None)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in score(docs, marks).collect()}
    assert all(out[k].toxic == (k % 5 == 0) for k in range(600))
    assert [out[k].toxic for k in (900, 901, 902, 903, None, 904)] == [0, 0, 1, 1, 0, 0]
    assert all(0 <= x.toxicity <= 1 for x in out.values())
    assert {x.toxic for x in score(docs, marks.limit(0)).collect()} == {0}
    assert score(spark.createDataFrame([], DOCS), marks).collect() == []


def test_words_known_by_their_stem_are_found_spaced(spark):
    from parchment.llm.toxicity import Reader, explaining, trigram_counts

    text = "the idiot and the clown are here with other words of this kind and idiotic clowns " * 50
    restorer = Restorer([tuple(r) for r in trigram_counts(spark.createDataFrame([(text,)], "text string")).collect()])
    reader = Reader(restorer, {"clow*": 0.9, "idio*": 0.9, "here*": 0.9})
    for line in ("what a c l o w n it is", "a c l o w n s here", "an i d i o t i c one", "t h e c l o w n", "a c l 0 w n"):
        assert reader.score(line) > 0.8, line
    assert reader.score("o t h e r w o r d s") < 0.3
    rows = [[0, 1, 2]] * 40
    kept = explaining(rows, [("clow*", 0.98), ("clown", 0.98), ("alone", 0.98)])
    assert "clown" in kept and "alone" not in kept


def test_long_tokens_are_restored_whole(spark):
    from parchment.llm.toxicity import Reader, trigram_counts

    text = "the idiot and the clown are here with other words of this kind " * 50
    restorer = Restorer([tuple(r) for r in trigram_counts(spark.createDataFrame([(text,)], "text string")).collect()])
    reader = Reader(restorer, {"clown": 0.9, "idiot": 0.9})
    assert restorer.word("i" * 60 + "d1ot") == "idiot" and restorer.word("cl0wn" + "." * 100_000) == "clown"
    assert reader.score("c" + "-" * 60 + "l0wn") > 0.8
    assert reader.score(" ".join("theotherwordsofthiskindareherewiththeotherwords" * 2 + "cl0wn")) > 0.8
    assert all(map(suspicious, ("(|0+", "@$$", "@.$.$")))
    assert not any(map(suspicious, ("455", "$455", "455€", "!!!", "+1", "$$$", "$1,455.50", "(12)", "12:30", "...", "")))


VEC = "vec_id long, embedding array<float>, label int"


def test_vectors_against_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(5)
    base = r.normal(size=(40, 16))
    rows = []
    for k in range(900):
        v = base[k % 40] + r.normal(size=16) * (0.05 if k % 3 else 0.6)
        rows.append((k, [float(x) for x in v.astype("f4")], k % 2))
    rows += [(2000, rows[0][1], 0), (2001, None, 0), (2002, [0.0] * 16, 0), (2003, [None] + [1.0] * 15, 0), (2004, [float("nan")] * 16, 0), (2005, rows[0][1], None), (2006, [1.0, 0.0], 0), (None, rows[1][1], 1), (2007, [], 1)]
    out = {x.vec_id: x for x in link_vectors(spark.createDataFrame(rows, VEC).selectExpr("*", "1 as uid", "'x' as shelf").repartition(4)).collect()}
    good = [(k, np.array(v), lab) for k, v, lab in rows[:901]] + [(None, np.array(rows[1][1]), 1)]
    x = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    same = np.array([lab for *_, lab in good])
    link = (x @ x.T >= 0.93) & (same[:, None] == same[None, :])
    np.fill_diagonal(link, False)
    n = link.sum(1)
    got = np.array([out[k].n_links for k, *_ in good])
    assert (got <= n).all() and got.sum() >= 0.97 * n.sum()
    low = np.array([k if k is not None else 10**9 for k, *_ in good])
    while True:
        new = np.minimum(low, np.where(link, low[None, :], 10**9).min(1))
        if (new == low).all():
            break
        low = new
    assert np.mean([out[k].component_id == c for (k, *_), c in zip(good, low)]) > 0.99
    for k in (2001, 2002, 2003, 2004, 2005, 2006, 2007):
        assert (out[k].n_links, out[k].component_id, out[k].kept) == (0, k, True)
    assert link_vectors(spark.createDataFrame([], VEC)).collect() == []


def test_long_words_are_found_spaced():
    """Whole words of any length inside spaced letters."""
    from parchment.llm.toxicity import Reader

    word = "antidisestablishmentarianism"
    reader = Reader(Restorer([]), {word: 0.9, "clown": 0.9})
    assert reader.features(" ".join(word)) == {word}
    assert reader.features("so " + " ".join("xx" + word + "clown") + " it is") == {word, "clown"}
