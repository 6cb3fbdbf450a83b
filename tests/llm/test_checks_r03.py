"""What the check of round 3 found, each in small."""

import gc

import pyarrow as pa

from cohortlens.llm import decontaminate, quality, shingles, tokens, worker


def test_texts_of_windows_travel_as_texts(spark, monkeypatch):
    """op8: whatever the number of keys, documents are dealt to their windows by one plan, as texts and not as arrays of words."""
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(0, f"a b c {passage} d e"), (1, "nothing of it at all, not even near"), (2, None)], "doc_id long, text string")
    plans = []
    save = decontaminate.Tables.save
    monkeypatch.setattr(decontaminate.Tables, "save", lambda self, df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or save(self, df, name))
    got = decontaminate.contamination(docs, spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_items, r.item_id) for r in got) == [(0, 1, 7), (1, 0, None), (2, 0, None)]
    plan = dict(plans)["window-shingles"]
    semi = next(x for x in plan.splitlines() if "LeftSemi" in x)
    assert "ShuffledHashJoin" in semi
    below = plan[plan.index(semi) :]
    assert "split(" not in below


def test_workers_forget_other_stages():
    """pipeline: a worker that goes from stage to stage doesn't carry along what the stages before remembered."""
    quality.features(pa.array(["One two three"]))
    assert quality._known
    shingles.word_hashes(pa.array(["one two"]))
    assert shingles._known and not quality._known
    tokens.encoder(tokens.default_tokenizer())
    assert tokens._KNOWN and not shingles._known
    first = tokens.encoder(tokens.default_tokenizer())
    assert tokens.encoder(tokens.default_tokenizer()) is first  # of one kind it is kept
    worker.begin("shingles")
    assert not tokens._KNOWN


def test_words_with_signs_take_the_ids_of_the_bare_word():
    """op9, op10: the model is asked once for a word however it is punctuated, and never while Python looks for cycles."""
    enc = tokens.WordEncoder(tokens.default_tokenizer())
    text = "x zorblefink zorblefink, Zürblefänk zorblefink... Zürblefänk! zorblefink. zorblefink%%% 12, a-b. ,"
    want = enc.tok.encode(text, add_special_tokens=False).ids

    class Asked:
        def __init__(self, model):
            self.model, self.words = model, []

        def tokenize(self, s):
            assert not gc.isenabled()
            self.words.append(s)
            return self.model.tokenize(s)

    enc.model = Asked(enc.model)
    for _ in range(2):
        got = [x.tolist() for *_, x in enc.encode(pa.array([text]))]
        assert got == [want]
    asked = [w for w in enc.model.words if "blef" in w]
    assert len(asked) == len(set(asked)) == 2
    assert gc.isenabled()


def test_new_words_are_encoded_once_and_as_the_library_does(monkeypatch):
    """op9: a word that comes first with signs and then bare is encoded once (before: twice); line breaks, other scripts and a small memory give the library's ids."""
    import random

    import pyarrow as pa

    from cohortlens.llm import tokens

    enc = tokens.WordEncoder(tokens.default_tokenizer())
    real, seen = enc.model, []

    class Counting:
        def tokenize(self, word):
            seen.append(word)
            return real.tokenize(word)

    enc.model = Counting()
    list(enc.encode(pa.array(["x wordily, wordily wordily. wordily!!"])))
    assert sum(w.endswith("wordily") for w in seen) == 1
    rnd = random.Random(9)
    words = ["Größe", "größe.", "Größe,", "слово", "слово!", "語", "don't", "it's.", "a\nb", "c.\nD", "x\n\ny", "\nz", "w\n", "q\tr", "q\tr.\ns", "é b", "3.14", "...", "", "U V", "m\x1cn\no", "²", "ǅ", "n\r\no", "ab", "ab.", "ab.\nab"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 30))) for _ in range(300)]
    enc = tokens.WordEncoder(tokens.default_tokenizer())
    monkeypatch.setattr(tokens, "MEMORY", 20)  # so that what an older memory holds is taken over
    for a in range(0, 300, 20):
        got = [(counts.tolist(), ids.tolist()) for _, _, counts, ids in enc.encode(pa.array(texts[a : a + 20]), end_id=0)]
        want = [enc.tok.encode(t, add_special_tokens=False).ids + [0] for t in texts[a : a + 20]]
        assert [n for c, _ in got for n in c] == list(map(len, want)) and [i for _, x in got for i in x] == [i for x in want for i in x]
