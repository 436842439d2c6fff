from tarmac.llm import language_id as li


def plain_phrases(text, sample):
    """Greedy longest matches, one letter at a time."""
    n, k = 0, 0
    while k < len(text):
        size = 0
        while k + size < len(text) and text[k : k + size + 1] in sample:
            size += 1
        n += 1
        k += max(size, 1)
    return n


def test_phrases_match_plain_parsing():
    samples = {"a": ["the cat sat on the mat and the rat"], "b": ["der hund und die katze auf der matte"]}
    parser = li.CrossParser(samples)
    for text in ("the mat and the hund", "die ratte", "xyz", "matte on the katze und cat"):
        counts, letters = parser.phrases([text])
        want = [plain_phrases(text, samples[k][0]) for k in ("a", "b")]
        assert counts[0].tolist() == want
        assert letters[0] == sum(c.isalpha() for c in text)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = li.held_out()
    out = li.identify(docs, li.fit(docs, ~held)).join(docs.select("doc_id", "lang", held.alias("held"), "text"), "doc_id").filter("held").collect()
    known = [r for r in out if r.lang_pred != "und"]
    assert len(known) > 150
    assert sum(r.lang_pred == r.lang for r in known) >= 0.97 * len(known)
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_rows(odd):
    parser = li.fit(odd, ~li.held_out())
    out = li.identify(odd, parser).collect()
    assert len(out) == odd.count()
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 8, 11))
    assert got[1].lang_pred != "und"
    kept = li.keep_identified(odd, parser)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, None, 6, 7, 9, 10}


def test_no_labels_and_empty(odd):
    from pyspark.sql import functions as F

    none = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in li.identify(none, li.fit(none, ~li.held_out())).collect()} == {"und"}
    assert li.identify(odd.limit(0), li.fit(odd.limit(0), ~li.held_out())).count() == 0


def test_letters_beyond_the_dense_classes_parse_plainly():
    """Thousands of distinct letters: those without a column in the table are told apart like the others."""
    import random

    rng = random.Random(4)
    han = [chr(0x4E00 + k) for k in range(1500)]
    samples = {"a": ["".join(rng.choice(han) for _ in range(3000))], "b": ["".join(rng.choice(han[700:] + ["\U00020000"]) for _ in range(3000))], "c": ["der hund und die katze"]}
    parser = li.CrossParser(samples)
    assert parser.total > 4 * li.DENSE
    for text in (samples["a"][0][100:400], samples["b"][0][:300], "".join(rng.choice(han) for _ in range(300)), "hund" + "".join(han[:50]) + "katze", "\U00020000鿿" + han[0]):
        counts, letters = parser.phrases([text])
        assert counts[0].tolist() == [plain_phrases(text, samples[k][0]) for k in ("a", "b", "c")]
        assert letters[0] == len(text)


def test_cjk_texts_are_told_apart_and_signs_are_no_letters():
    samples = {"ja": ["日本語の文章はひらがなと漢字で書かれています。東京は日本の首都です。"], "ko": ["한국어 문장은 한글로 쓰여 있습니다. 서울은 대한민국의 수도입니다."], "zh": ["中文句子是用汉字书写的。北京是中华人民共和国的首都。"]}
    texts = ["東京は日本です", "서울은 대한민국의", "北京是中华人民", "😀😀 🎉", "！？，．", "、。〜", "ＡＢＣ"]
    pred, score = li._judged(li.CrossParser(samples), texts)
    assert pred[:6] == ["ja", "ko", "zh", "und", "und", "und"] and pred[6] != "und"
    assert score[3:6] == [0.0, 0.0, 0.0]


def test_segments_ties_and_scores_match_plain_parsing():
    """A text counts by its segments; equal counts go to the first language; the score is what the winner saves against the next."""
    samples = {"ar": ["هذه جملة عربية عن القط والحصيرة"], "en": ["the cat sat on the mat"], "nl": ["the cat sat on the mat"], "ru": ["это русское предложение о кошке и коврике"]}
    parser = li.CrossParser(samples, segment=16)
    texts = ["the cat and the mat are on the mat of the cat", "русская кошка сидит на коврике и это русское предложение", "القط على الحصيرة هذه جملة عربية", "Ω", "the mat " * 40]
    pred, score = li._judged(parser, texts)
    for text, p, s in zip(texts, pred, score, strict=True):
        squeezed = text.lower()
        counts = {k: sum(plain_phrases(squeezed[a : a + 16], v[0]) for a in range(0, len(squeezed), 16)) for k, v in samples.items()}
        best, second = sorted(counts.values())[:2]
        assert p == min(counts, key=lambda k: (counts[k], k)) and abs(s - (1 - best / second)) < 1e-12
    assert pred == ["en", "ru", "ar", "ar", "en"] and score[0] == score[3] == 0.0


def test_many_languages_fit_the_table():
    """Seventy languages of 160 letters each, most of which have no column of their own."""
    samples = {f"l{k:02d}": ["".join(chr(0x4E00 + 160 * k + (j * j + 7 * j * k) % 160) for j in range(2000))] for k in range(70)}
    parser = li.CrossParser(samples, train_chars=2000)
    assert parser.table.size <= li.ENTRIES and parser.classes < li.DENSE
    texts = [samples[f"l{k:02d}"][0][300:420] for k in (0, 33, 69)]
    pred, _ = li._judged(parser, texts)
    assert pred == ["l00", "l33", "l69"]
    counts, _ = parser.phrases(texts)
    assert counts[:, [0, 33, 69]].tolist() == [[plain_phrases(t, samples[f"l{k:02d}"][0]) for k in (0, 33, 69)] for t in texts]
