"""Character sets told apart: whole texts of several languages, short pieces, odd bytes."""

from __future__ import annotations

import random

import pytest

from storyspark.sources import files
from storyspark.sources.charsets import detect

TEXTS = {
    "zh": "昨天晚上我和朋友一起去看了一场电影，电影讲的是一个年轻人离开家乡到大城市寻找工作的故事。他遇到了许多困难，但是最后还是找到了自己的方向。我们都觉得这部电影拍得很好，演员的表演也很自然。回家的路上我们讨论了很久，直到地铁站关门。",
    "tw": "昨天晚上我和朋友一起去看了一場電影，電影講的是一個年輕人離開家鄉到大城市尋找工作的故事。他遇到了許多困難，但是最後還是找到了自己的方向。我們都覺得這部電影拍得很好，演員的表演也很自然。回家的路上我們討論了很久，直到地鐵站關門。",
    "ja": "昨日の夜、友達と一緒に映画を見に行きました。若者が故郷を離れて大都市で仕事を探すという話でした。彼は多くの困難に出会いましたが、最後には自分の道を見つけました。とても良い映画だったと思います。帰り道でも、私たちはずっとその話をしていました。",
    "ko": "어제 저녁에 친구와 함께 영화를 보러 갔습니다. 젊은이가 고향을 떠나 큰 도시에서 일자리를 찾는 이야기였습니다. 그는 많은 어려움을 만났지만 마지막에는 자신의 길을 찾았습니다. 우리는 모두 좋은 영화라고 생각했습니다.",
    "fr": "Hier soir, je suis allé voir un film avec des amis. C'était l'histoire d'un jeune homme qui quitte son pays natal à la recherche d'un métier. Il a rencontré beaucoup de difficultés, mais à la fin il a trouvé sa voie. L'été dernier déjà.",
}
CASES = [("zh", "gb18030"), ("tw", "big5"), ("tw", "gb18030"), ("ja", "shift_jis"), ("ja", "euc_jp"), ("ko", "euc_kr"), ("fr", "latin-1"), ("fr", "gb18030"), ("zh", "utf-16-le"), ("ja", "utf-16-be"), ("fr", "utf-16-le")]


@pytest.mark.parametrize("language,charset", CASES)
def test_whole_texts_and_pieces(language, charset):
    text = TEXTS[language]
    assert detect(text.encode(charset)) == (text, charset, True)
    rng = random.Random(2)
    wrong = 0
    for _ in range(300):
        start = rng.randrange(len(text) - 60)
        piece = text[start : start + rng.randint(30, 60)]
        wrong += not piece.isascii() and detect(piece.encode(charset))[0] != piece
    assert wrong <= 3


def test_mixed_latin_words_in_eastern_texts():
    for language, charset in CASES[:6]:
        text = f"Spark 4.1: {TEXTS[language]} (DataFrame, SQL)"
        assert detect(text.encode(charset))[0] == text


def test_marks_and_odd_bytes():
    assert detect("é".encode("utf-16")) == ("é", "utf-16-le", True)
    assert detect(b"\xfe\xff" + "日本".encode("utf-16-be"))[:2] == ("日本", "utf-16-be")
    assert detect(b"\xff")[1] == "latin-1" and not detect(b"\xa8\xa6")[2] is None
    assert detect("plain text".encode("utf-16-le"))[1] == "utf-16-le"


def test_accents_side_by_side():
    for text in ("Çèen en vich de.", "Éé la, une équepapa.", "Enelle le éèpaeux."):  # pairs that Big5 has for a Cyrillic letter, EUC-KR and GB18030 for a sign
        assert detect(text.encode("latin-1"))[:2] == (text, "latin-1")
    for text in ("I say 这个人 now", "Вчера вечером мы ходили смотреть фильм о Shanghai.", "Spark 的 DataFrame"):
        assert detect(text.encode("gb18030"))[0] == text


def test_short_and_repeated_words():
    latin = ("Èé", "Éévi", "Íí", "èé", "ü", "für", "Ééan", "Èçiereux")
    for text in [" ".join([w] * n + ["ou oi de"]) for w in latin for n in (1, 7, 200)] + [" ".join(["éè"] * n) for n in (2, 50)]:  # once read as Chinese, Korean, UTF-16 or nothing at all
        assert detect(text.encode("latin-1"))[:2] == (text, "latin-1")
    for text in ("UNE!! RE,!! DE!! ÈÉOI.!! ENEN!!", "No el ñó", "stpfö für.", "Dans. Çêch le"):
        assert detect(text.encode("latin-1"))[:2] == (text, "latin-1")
    for n in (1, 2, 500):  # in EUC-JP hiragana that never stand so, in EUC-KR a Cyrillic letter
        for text in ("中不中國" * n, "中國中不" * n, "為為" * n):
            assert detect(text.encode("big5"))[:2] == (text, "big5")


def test_bytes_that_are_valid_utf8_by_chance(spark):
    rows = [(1, "一时".encode("gb18030")), (2, ("一时" * 9).encode("gb18030")), (3, "Вечер, ίδιος, naïve, šum, əlifba, қала, האור, 'fəʊniːm".encode()), (4, "Қазақстан Республикасы, әлем".encode())]
    got = {r.id: (r.text, r.encoding) for r in files.decode_charset(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert got[1] == ("一时", "gb18030") and got[2] == ("一时" * 9, "gb18030")
    assert [got[k] for k in (3, 4)] == [(rows[k - 1][1].decode(), "utf-8") for k in (3, 4)]


def test_rows(spark):
    rows = [(1, "naïve".encode()), (2, TEXTS["tw"].encode("big5")), (3, None), (4, b""), (5, TEXTS["ja"].encode("shift_jis")), (6, "plain".encode("utf-16-le")), (7, b"\xa1")]
    got = {r.id: (r.text, r.encoding, r.error, r.sure) for r in files.decode_charset(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert got[1] == ("naïve", "utf-8", None, True) and got[4] == ("", "utf-8", None, True)
    assert got[2] == (TEXTS["tw"], "big5", None, True) and got[5] == (TEXTS["ja"], "shift_jis", None, True)
    assert got[3] == (None, None, "no known encoding fits", False) and got[6][:2] == ("plain", "utf-16-le") and not got[7][3]
