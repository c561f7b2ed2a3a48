import random

import pytest
from tokenizers import Tokenizer

from lexispectra.llm import encoder
from lexispectra.llm.encoder import Encoder, tokenizer_path

ODD = [
    None,
    "",
    " ",
    "\n\n  x\n y",
    "don't we're I'LL",
    "a  b \t c　 d  e f",
    "x<|endoftext|> y <|startoftext|>",
    "<|EndOfText|>",
    "a\x1cb \x1d c",
    "É été ÀÇ ñ ß Straße, ÖL; “quoted”, foo’s ét ñ.",
    "a̸ ≠ , ́x,́y",
    "12,5 a1b2 ...!? $$$ word### x,y;z",
    "Ärger᠎ x",
    "한국어 中文 текст ΣΑΣ",
    "\U0001f600 \U0001f600\U0001f601 z",
    "tail space ",
    " a  b​c",
]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_equals_the_library_on_whole_texts(name, spaced):
    random.seed(3)
    alphabet = "abcXYZ ,.'!\n\t  éÉñ12# 　́’-"
    texts = ODD + ["".join(random.choices(alphabet, k=random.randint(1, 60))) for _ in range(3000)]
    library = Tokenizer.from_file(tokenizer_path(name))
    ids, bounds = Encoder(tokenizer_path(name), 7, spaced).encode(texts)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids + [7], repr(text)


def test_forgets_only_chunks_that_were_not_met_again(monkeypatch):
    monkeypatch.setattr(encoder, "REMEMBERED", 60)
    learnt = []
    made = Encoder(tokenizer_path("byte_bpe_50k.json"), 7, True)
    learn = made._learn
    monkeypatch.setattr(made, "_learn", lambda chunks: (learnt.extend(chunks), learn(chunks)))
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for n in range(40):
        texts = ["common words, $5 " + f"rare{n} once{n}", f"more common words {n * 7}"]
        ids, bounds = made.encode(texts)
        for text, a, b in zip(texts, bounds, bounds[1:]):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids + [7], text
    assert learnt.count(" common") == 1 and len(made._number) <= 70


def test_forgets_all_when_most_were_met_again(monkeypatch):
    monkeypatch.setattr(encoder, "REMEMBERED", 20)
    made = Encoder(tokenizer_path("byte_bpe_50k.json"), 7, True)
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for n in range(12):
        text = " ".join(f"w{i}" for i in range(15 if n < 6 else 30))
        ids, _ = made.encode([text, text])
        assert ids.tolist() == 2 * (library.encode(text, add_special_tokens=False).ids + [7])
        assert len(made._number) <= 20 + 31
