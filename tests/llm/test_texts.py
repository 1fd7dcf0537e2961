"""Encoding, packing, sentences."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notelake.llm import encode, packing, sentences

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")
DOC = "doc_id bigint, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return encode.Encoder(f.read())


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_encoding_equals_the_library(own, library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert own.encode(text) == library(text)


def test_forced_cuts_keep_every_token_whole(own, library):
    assert not any(len(list(own.fragments(t))) > 1 for t in own.ranks)
    long = "a" * 20_000 + "é" * 3000 + " \n" * 500 + "漢" * 2000
    assert own.encode(long) == library(long)
    back = {v: k for k, v in own.ranks.items()}
    assert b"".join(back[i] for i in own.encode(long)).decode() == long


def test_encode_rows(spark, library):
    rows = [(1, "Hello  world's end", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y"), (3, "", "x", "y"), (None, "<|endoftext|>", "x", "y")]
    df = spark.createDataFrame(rows, DOC)
    got = sorted(((r.doc_id or 0, r.ids) for r in encode.encode(df, "doc_id", "text", PATH).collect()))
    assert got == [(0, library("<|endoftext|>")), (1, library("Hello  world's end")), (2, []), (3, []), (3, [])]
    assert encode.encode(df.limit(0), "doc_id", "text", PATH).count() == 0
    assert sorted(r.n_tokens for r in encode.token_counts(df, "doc_id", "text", PATH).collect()) == sorted(len(i) for _, i in got)


def test_packs(spark):
    rnd = random.Random(0)
    sizes = [rnd.choice([rnd.randint(1, 60), rnd.randint(1, 400), rnd.randint(1, 2048), rnd.randint(1, 9000)]) for _ in range(3000)] + [0, None, 100, 100, 4096]
    rows = [(i % 2990, s, "p", 7) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id int, size int, pack_id string, piece int")
    got = packing.harmonic_packs(df, "doc_id", "size").toPandas()
    assert got.n_tokens.sum() == sum(s or 0 for s in sizes)
    used = got.dropna(subset=["pack_id"]).groupby("pack_id").n_tokens.sum()
    assert used.max() <= 2048 and used.sum() / (2048 * len(used)) > 0.99 and sorted(used.index) == list(range(len(used)))
    assert (got[got.pack_id.isna()].n_tokens == 0).all() and got.pack_id.isna().sum() == 2
    whole = got[(got.n_tokens > 0) & (got.piece == 0)]
    assert len(whole) == sum(1 for s in sizes if s)
    assert (got[got.piece > 0].start_token == got[got.piece > 0].piece * 2048).all()
    assert packing.harmonic_packs(df.limit(0), "doc_id", "size").count() == 0


def test_one_size_may_hold_all_items(spark):
    df = spark.createDataFrame([("k", 500)] * 1001, "first string, rank int")
    assert sorted(packing.harmonic_packs(df, "first", "rank").toPandas().groupby("pack_id").size()) == [1] + [4] * 250


def bins(sizes, capacity):
    """The sizes in each container of a plan."""
    counts = {s: sizes.count(s) for s in set(sizes)}
    slots, out = packing.plan(counts, capacity), {}
    for s, n in counts.items():
        mine = [x[1:] for x in slots if x[0] == s]
        assert mine[0][0] == 0 and mine == sorted(mine)
        for (first, per, at), end in zip(mine, [*(x[0] for x in mine[1:]), n], strict=True):
            for r in range(first, end):
                out.setdefault(at + (r - first) // per, []).append(s)
    return [sorted(out[i], reverse=True) for i in range(len(out))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_places_each_item_once(sizes):
    got = bins(sizes, 40)
    assert sorted(s for b in got for s in b) == sorted(sizes) and all(sum(b) <= 40 for b in got)


def test_classes_are_filled_by_count():
    got = bins([30] * 6 + [19] * 5 + [12] * 9 + [5] * 10, 60)
    assert got == [[30, 30]] * 3 + [[19, 19, 19], [19, 19, 12, 5, 5], [12] * 5, [12, 12, 12, 5, 5, 5, 5], [5] * 4]
    # every container of a class gets its first filler before any gets a second; the largest that fits would give 37 10 8
    assert bins([37, 35, 10, 8], 60) == [[37, 10], [35, 8]]


CASES = {
    "Ao lado do pacote.O Sr. Zé mediu. No painel estável.A equipe foi.Der Tag kam.": ["Ao lado do pacote.", "O Sr. Zé mediu.", "No painel estável.", "A equipe foi.", "Der Tag kam."],
    "One. Two! Three? Really?! End": ["One.", "Two!", "Three?", "Really?!", "End"],
    "Dr. No met Mr. J. Q. Public at 3.45 p.m. today. See Fig. 3, i.e. v1.2.3.\nIt works.": ["Dr. No met Mr. J. Q. Public at 3.45 p.m. today.", "See Fig. 3, i.e. v1.2.3.", "It works."],
    "It was late.The next one? `a.b()` is code. x.md is a file.": ["It was late.", "The next one?", "`a.b()` is code.", "x.md is a file."],
    'He wrote. "Stop. Go!" said Ann. The log said "all is well." Next. “Who? Me?” she asked, and left.': ["He wrote.", '"Stop. Go!" said Ann.', 'The log said "all is well."', "Next.", "“Who? Me?” she asked, and left."],
    "The one (it was old. Nobody cared.) stays. It is, well... stale. See https://x.y/z?a=1.5. Done ... but kept.": ["The one (it was old. Nobody cared.) stays.", "It is, well... stale.", "See https://x.y/z?a=1.5.", "Done ... but kept."],
    "Kurze Schlüssel, z. B. eins, d. h. zwei. Am 3. Mai kam die 2. Fassung. „Ist er alt? Ja!“ fragte Max.": ["Kurze Schlüssel, z. B. eins, d. h. zwei.", "Am 3. Mai kam die 2. Fassung.", "„Ist er alt? Ja!“ fragte Max."],
    "Mme Un a dit : « Est-il prêt ? Oui. » M. Deux, p. ex. hier, dort !": ["Mme Un a dit : « Est-il prêt ? Oui. »", "M. Deux, p. ex. hier, dort !"],
    "¿Quién? ¡No! El Sr. Paz vive en EE. UU. desde la pág. 3.": ["¿Quién?", "¡No!", "El Sr. Paz vive en EE. UU. desde la pág. 3."],
    "В 2024 г. всё, т. е. тест, и т. д. Проф. Иванов. «Стой. Иди!» сказал он.": ["В 2024 г. всё, т. е. тест, и т. д.", "Проф. Иванов.", "«Стой. Иди!» сказал он."],
    "Δείτε π.χ. το αρχείο. Ποιος φταίει; Ο κ. Χ ήρθε.": ["Δείτε π.χ. το αρχείο.", "Ποιος φταίει;", "Ο κ. Χ ήρθε."],
    "قاس د. علي ذلك. من راجع؟ «بطيء. من؟» سأل علي.": ["قاس د. علي ذلك.", "من راجع؟", "«بطيء. من؟» سأل علي."],
    "डॉ. राम ने 3.5 मि.से. मापा। “पूरी है। कौन?” राम ने पूछा।": ["डॉ. राम ने 3.5 मि.से. मापा।", "“पूरी है। कौन?” राम ने पूछा।"],
    "파일이 없다. \"누가 만들까?\"라고 물었다. 끝났다.": ["파일이 없다.", "\"누가 만들까?\"라고 물었다.", "끝났다."],
    "止まった…しかし動いた。「古い。直そう。」と書いた。本当？！（完全です。）はい。": ["止まった…しかし動いた。", "「古い。直そう。」と書いた。", "本当？！", "（完全です。）はい。"],
    "他写道：「停下。检查！」真的吗？“很旧。谁来？”他问道。": ["他写道：「停下。检查！」", "真的吗？", "“很旧。谁来？”他问道。"],
    "ระบบทำงาน v2.4 เสถียร ทีมเก็บเอกสาร": ["ระบบทำงาน v2.4 เสถียร", "ทีมเก็บเอกสาร"],
    "---\ntitle: a. b\n---\n# A. B? C\n\n#tag #two\n\n- [ ] One. Two\n- [x] Three\n1. Four\n2. Five. Six\n\n> Quote one.\n> Quote two\n\n```py\nx. Y. Z\n```\nText\ngoes on. End": [
        "A. B? C", "One.", "Two", "Three", "Four", "Five.", "Six", "Quote one.", "Quote two", "Text\ngoes on.", "End"],
    "﻿## Title\r\n\r\nA b.\r\nC d.\r\n": ["Title", "A b.", "C d."],
    "3. First item\n" + "goes on and on\n" * 9 + "4. Second item. " + "x" * 900 + "\n5. Third": ["First item\n" + ("goes on and on\n" * 9).strip(), "Second item.", "x" * 900, "Third"],
    "It began in\n1999. Then it\n2000. ended.\n1. One\n12. Two": ["It began in\n1999.", "Then it\n2000.", "ended.", "One", "Two"],
    "Am" + " " * 50 + "3. Mai kam er. Wort:" + " " * 40 + "„Ja. Nein!“ und ging. В 2024" + " " * 30 + "г. всё.": ["Am" + " " * 50 + "3. Mai kam er.", "Wort:" + " " * 40 + "„Ja. Nein!“ und ging.", "В 2024" + " " * 30 + "г. всё."],
    "ระบบทำงาน" + " " * 300 + "ทีมเก็บเอกสาร": ["ระบบทำงาน", "ทีมเก็บเอกสาร"],
    "~~~\nopen. Fence": [],
    "": [],
    " \n\t": [],
    "...": [],
    "😀 Hi. 😀": ["😀 Hi.", "😀"],
}


def test_sentences(spark):
    texts = list(CASES)
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)] + [(None, None, "a", "b")], "doc_id bigint, text string, start_pos string, p string")
    out = {}
    for r in sentences.sentences(df, "doc_id", "text").orderBy("doc_id", "start_pos").collect():
        out.setdefault(r.doc_id, []).append(texts[r.doc_id][r.start_pos - 1 : r.end_pos])
    for i, t in enumerate(texts):
        assert out.get(i, []) == CASES[t], t


def test_sentences_of_long_texts(spark):
    texts = ["Word one two three. " * 50_000, "a" * 300_000, "(" * 5000 + "x. Y", '"' * 4001 + " a. B", "x\n" * 20_000 + "Yes. Zed", "`" * 9999]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n for r in sentences.sentences(df, "doc_id", "text").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert got[0] == 50_000 and got[1] == 1 and got[4] == 2
    assert sentences.sentences(df.limit(0), "doc_id", "text").count() == 0
