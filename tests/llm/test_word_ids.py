"""Word ids of a column of texts: those of the library, with one lookup for each different word."""

import pyarrow as pa

from epiflux.llm import simple8b

ODD = [
    "", None, " ", "a  b\n", "<|ENDoftext|> Hi", "x<|startoftext|>y.", "İstanbul ÀÉ, ÿ Ÿ µ ſ K ª º ¼ \xad \xa0x", "it's don't. 12,3. ...",
    "日本語。 Straße STRASSE ß", "\x1c\x1d a\x85b c", "🙂🙂 a🙂.", "Ａ．", "a.b,c.,", "<", "<b>", "\x00x",
]


def test_column_has_the_ids_of_the_library():
    words = simple8b.load_words()
    want = [words.library.encode(text or "", add_special_tokens=False).ids for text in ODD]
    assert [ids.tolist() for ids in words.encode_all(pa.array(ODD, pa.string()))] == want
    assert [ids.tolist() for ids in words.encode_all(pa.array(["x", *ODD], pa.string()).slice(1))] == want
    assert [list(memoryview(words.encode(text and text.encode())).cast("I")) for text in ODD] == want
    assert words.encode_all(pa.array([], pa.string())) == []


def test_each_word_of_a_column_is_looked_up_once():
    words, asked = simple8b.load_words(), []

    class Counted(simple8b._Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    words.words = Counted(words)
    words.encode_all(pa.array(["one two one two one"] * 100, pa.string()))
    assert sorted(asked) == [b"one", b"two"]


def test_a_piece_of_several_words_is_tokenized_once():
    words, asked = simple8b.load_words(), []

    class Model:
        tokenize = staticmethod(lambda piece, model=words.model: asked.append(piece) or model.tokenize(piece))

    words.model = Model
    texts = ["one### two### ###one two'll###,one", "Ä### ä###one"]
    want = [words.library.encode(text, add_special_tokens=False).ids for text in texts]
    assert [ids.tolist() for ids in words.encode_all(pa.array(texts))] == want
    assert len(asked) == len(set(asked))
