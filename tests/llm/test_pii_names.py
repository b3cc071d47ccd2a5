"""op9: whole names, and surrogates of names that stay distinct and the same everywhere."""

import pytest

from depthlane.llm import pii


@pytest.mark.parametrize(("text", "name"), [
    ("Senor x Señor Juan Garcia Marquez came", "Juan Garcia Marquez"), ("Mrs. Anna von Berg came", "Anna von Berg"), ("Mr. J. Smith came", "J. Smith"), ("Mr. J. R. R. Tolkien, x", "J. R. R. Tolkien"),
    ("Dr. Ludwig van der Rohe.", "Ludwig van der Rohe"), ("my name is Conan O'Brien and", "Conan O'Brien"), ("Prof. Dr. Hans Müller-Lüd sagt", "Hans Müller-Lüd"), ("Mr. John F Kennedy was", "John F Kennedy"),
    ("Madame Jeanne d'Arc est", "Jeanne d'Arc"), ("Don Pedro de la Vega y Ruiz", "Pedro de la Vega y Ruiz"), ("Herr Braun von dort", "Braun"), ("г-жа Анна Петровна Иванова", "Анна Петровна Иванова"),
])
def test_whole_names(text, name):
    assert [text[a:b] for a, b, _ in pii.detect(text)] == [name]


def test_two_names_of_a_sentence():
    text = "Mr. Smith Mrs. Maria Lopez Diaz and Mr. J. Doe"
    assert [text[a:b] for a, b, _ in pii.detect(text)] == ["Smith", "Maria Lopez Diaz", "J. Doe"]


def test_words_of_names_map_alike():
    one, two = (pii.surrogate(b"k", "name_m", n) for n in ("James", "Robert James"))
    assert two.split()[1] == one
    assert len({pii.surrogate(b"k", "name_f", n) for n in ("Maria", "MaRia", "MARIA")}) == 3


def test_operators_fail_on_colliding_surrogates(spark):
    """Sound surrogates pass; a shared surrogate or an original with two of them stops the operator."""
    docs = spark.createDataFrame([(1, "mail a.b@c.org"), (2, "mail b.a@c.org"), (3, None)], "doc_id long, text string")
    for operator in (pii.entities, pii.redact):
        assert operator(docs, "k").count() == 3
    pairs = [("name", "x", "A"), ("name", "y", "A"), ("name", "z", "B"), ("name", "z", "C"), ("ip", "x", "A")]
    rows = spark.createDataFrame([(1, pairs)], "doc_id long, _p_pairs array<struct<type: string, original: string, surrogate: string>>")
    with pytest.raises(ValueError, match="shared.*split"):
        pii._checked(rows)


def test_no_key_no_surrogates(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org")], "doc_id long, text string")
    for operator in (pii.entities, pii.redact):
        with pytest.raises(ValueError, match="secret"):
            operator(docs)


@pytest.mark.parametrize(("text", "name"), [
    ("I met Maria Lopez Diaz there", "Maria Lopez Diaz"), ("昨日は田中太郎さんに会った", "田中太郎"), ("田中太郎、東京", "田中太郎"), ("你好，我叫王小明。", "王小明"), ("私の名前は山田花子です", "山田花子"), ("マイケルさん", "マイケル"),
    ("제 이름은 김민수입니다", "김민수"), ("박지성 씨", "박지성"),
])
def test_names_of_other_scripts(text, name):
    assert [text[a:b] for a, b, _ in pii.detect(text)] == [name]
    new = pii.redact_text(text, b"k")[0]
    assert name not in new and len(new) == len(text)


@pytest.mark.parametrize("text", ["Paris Texas is Big", "Grace. The end", "at 12:30:45 std::abc a::b ::1 1::2", "今日は東京へ", "大学 の教授です", "오늘 서울"])
def test_what_is_no_entity(text):
    assert pii.redact_text(text, b"k") == (text, [])


def test_endings_and_sounds_of_names_stay():
    for name in ("Jennifer", "Ivanka", "Müller", "Иванова", "Кузнецов", "Παπαδόπουλος"):
        for key in (b"k", b"l"):
            new = pii.surrogate(key, "name", name)
            kept = 2 if name[-1] in "ваов" else 1
            assert new != name and new[-kept:] == name[-kept:] and new[0].isupper() and new[1:].islower()
            assert [c in pii._VOWELS for c in new.lower()] == [c in pii._VOWELS for c in name.lower()]
    assert pii.surrogate(b"k", "name_f", "Peter") == pii.surrogate(b"k", "name_m", "Peter")


def test_check_digits_and_ranges_stay():
    import ipaddress

    fits = lambda n: sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(n))) % 10 == 0
    cards = [f"4111 1111 {k:04d} {j:04d}" for k in range(0, 9999, 501) for j in range(0, 9999, 97)]
    for n in cards:
        new = pii.surrogate(b"k", "card", n)
        assert new != n and new[0] == "4" and new[4] == " " and fits(new.replace(" ", "")) == fits(n.replace(" ", ""))
    assert len({pii.surrogate(b"k", "card", n) for n in cards}) == len(cards)
    for iban, good in (("DE44 5001 0517 5407 3249 31", True), ("DE45 5001 0517 5407 3249 31", False), ("GB29NWBK60161331926819", True)):
        new = pii.surrogate(b"k", "iban", iban)
        assert new != iban and new[:2] == iban[:2] and (int("".join(str(int(c, 36)) for c in new.replace(" ", "")[4:] + new[:4])) % 97 == 1) == good
    for text in ("10.0.0.1", "192.168.3.4", "127.0.0.1", "169.254.1.1", "fe80::1", "fd12:3456::9", "2001:db8::5"):
        new = pii.surrogate(b"k", "ip6" if ":" in text else "ip", text)
        own = next(n for n in map(ipaddress.ip_network, pii.SPECIAL[6 if ":" in text else 4]) if ipaddress.ip_address(text) in n)
        assert new != text and ipaddress.ip_address(new) in own
    for k in range(200):
        assert not any(ipaddress.ip_address(pii.surrogate(b"k", "ip", f"8.8.{k}.4")) in n for n in map(ipaddress.ip_network, pii.SPECIAL[4]))
    assert pii.redact_text("from 2001:DB8:0:0::5 to 2001:db8::5.", b"k")[0].lower().count(pii.surrogate(b"k", "ip6", "2001:db8::5")) == 2
