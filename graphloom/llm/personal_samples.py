"""Labelled spans of personal data, made by rule: prose of invented words with personal data in many forms, and with what looks alike."""

from __future__ import annotations

import random
from collections.abc import Iterator

LETTERS = ("abcdefghijklmnopqrstuvwxyz", "aeioustnrlm", "aeiouéèçàtnrslm", "abdeghinorstüöäß", "abcdefñóíátnrs", "абвгдеклмнопрст")
TOP_LEVELS = ("com", "org", "net", "de", "fr", "es", "co.uk", "io", "edu", "info")
HARMLESS_WORDS = ("version", "chapter", "page", "line", "in", "since", "until", "about", "room", "section", "order", "CC BY-NC", "no.", "at", "build", "ISBN", "commit", "token =", "key:")
PHONE_WORDS = ("tel", "phone", "call", "fax", "mobile", "Tel.", "T:")


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random, letters: str) -> str:
    word = "".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 2, 3, 4, 5, 6, 8, 11))))
    return word.capitalize() if rng.random() < 0.15 else word.upper() if rng.random() < 0.05 else word


def _prose(rng: random.Random, n: int, letters: str, mark: str) -> str:
    return " ".join(_word(rng, letters) + (rng.choice((".", ",", "!", "?", ".\n")) if rng.random() < 0.15 else "") + mark for _ in range(n))


def _host(rng: random.Random) -> str:
    name = "".join(rng.choice(LETTERS[0]) for _ in range(rng.randint(2, 9))) + (_digits(rng, 1) if rng.random() < 0.3 else "")
    return name + (".example" if rng.random() < 0.3 else "")


def _name(rng: random.Random) -> str:
    name = "".join(rng.choice(LETTERS[0]) for _ in range(rng.randint(2, 8)))
    return name + rng.choice(("", "", ".", "_", "-", "+")) + rng.choice(("", _digits(rng, 2), "".join(rng.choice(LETTERS[0]) for _ in range(4))))


def email(rng: random.Random) -> str:
    form, top = rng.randrange(8), rng.choice(TOP_LEVELS)
    if form < 5:
        return f"{_name(rng)}@{_host(rng)}.{top}"
    at, dot = rng.choice(((" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" (at) ", "."), ("(at)", "."), (" @ ", ".")))
    return f"{_name(rng).rstrip('.-_+')}{at}{_host(rng).replace('.', dot)}{dot}{top.replace('.', dot)}"


def ip(rng: random.Random) -> str:
    if rng.random() < 0.6:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    group = lambda: f"{rng.randrange(1 << rng.choice((4, 8, 12, 16, 16))):x}"
    left = [rng.choice(("2001", "fe80", "2a00", "fd12")), *(group() for _ in range(rng.randint(0, 3)))]
    return ":".join([*left, *(group() for _ in range(8 - len(left)))]) if rng.random() < 0.5 else ":".join(left) + "::" + ":".join(group() for _ in range(rng.randint(1, 3)))


def card(rng: random.Random) -> str:
    n = rng.choice((16, 16, 16, 16, 15, 14, 13, 19))
    digits = rng.choice("3456" * 3 + "1278901") + _digits(rng, n - 1)
    mark = rng.choice(("", "", "", " ", "-", ".", "  "))
    return mark.join(digits[i : i + 4] for i in range(0, n, 4))


def phone(rng: random.Random) -> str:
    d = lambda n: _digits(rng, n)
    mark = rng.choice((" ", "-", ".", "/"))
    return rng.choice((
        f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)}{d(9)}", f"+{d(2)}-{d(3)}-{d(7)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}){d(3)}-{d(4)}",
        f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(2)} {d(7)}", f"0{d(2)}{mark}{d(4)}{mark}{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"({d(4)}) {d(6)}",
    ))


def harmless(rng: random.Random) -> str:
    d = lambda n: _digits(rng, n)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    return rng.choice((
        lambda: f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2100)}",
        lambda: f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/{rng.randint(90, 2100)}", lambda: f"{rng.randint(0, 23)}:{d(2)}", lambda: f"{d(2)}:{d(2)}:{d(2)}",
        lambda: f"{rng.randint(0, 99)}.{d(rng.randint(1, 3))}", lambda: f"{rng.randint(0, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}", lambda: f"{d(1)}.", lambda: f"{d(1)}.{d(1)}.",
        lambda: f"{rng.randint(1, 999)},{d(3)}", lambda: f"{rng.randint(1, 999)},{d(3)},{d(3)}", lambda: f"${rng.randint(1, 99)},{d(3)}.{d(2)}", lambda: f"{rng.randint(1, 999)} €",
        lambda: d(rng.randint(1, 4)), lambda: d(rng.randint(5, 10)), lambda: f"#{d(rng.randint(2, 7))}", lambda: f"{d(2)}-{d(2)}", lambda: f"{d(3)}-{d(3)}", lambda: f"{d(2)}%",
        lambda: '"' + hexes(40) + '"', lambda: hexes(rng.choice((7, 8, 32, 40, 64))), lambda: hexes(40).upper(), lambda: mixed(rng.randint(12, 40)), lambda: "AKIA" + mixed(16).upper(),
        lambda: f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: "@" + _name(rng), lambda: f"mail{d(1)}",
        lambda: " ".join(d(rng.randint(1, 2)) for _ in range(rng.randint(3, 9))), lambda: f"v{d(1)}.{d(1)}", lambda: f"x{d(2)}y", lambda: f"{d(1)}x{d(4)}", lambda: f"[{d(2)}]", lambda: f"({d(4)})",
        lambda: "@", lambda: f"a@{d(1)}", lambda: f"{d(2)} @ {d(1)}.{d(2)}", lambda: f"{hexes(2)}:{hexes(2)}:{hexes(2)}:{hexes(2)}:{hexes(2)}:{hexes(2)}", lambda: f"http://{_host(rng)}.com/{d(4)}?id={d(6)}",
    ))()


def labelled_spans(n: int, seed: int = 1) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """n texts of at most 128 characters with their spans (start, end, kind)."""
    rng, kinds = random.Random(seed), {"email": email, "ip": ip, "card": card, "phone": phone}
    for _ in range(n):
        letters, mark = rng.choice(LETTERS), rng.choice(("",) * 8 + ("!!", "###", "%%"))
        text, spans = _prose(rng, rng.randint(0, 9), letters, mark)[-rng.randint(0, 60) or 60 :], []
        for _ in range(rng.choice((0, 1, 1, 1, 2))):
            real = rng.random() < 0.6
            kind = rng.choice(list(kinds)) if real else ""
            item = kinds[kind](rng) if real else harmless(rng)
            if not real and rng.random() < 0.5:
                text += (" " if text else "") + rng.choice(HARMLESS_WORDS)
            elif kind == "phone" and rng.random() < 0.3:
                text += (" " if text else "") + rng.choice(PHONE_WORDS) + rng.choice(("", ":"))
            text += rng.choice((" ", " ", " ", "\n", " (", ': "')) if text else ""
            at = len(text)
            text += item + rng.choice(("", "", "", mark, ".", ",", ")", '"', ";"))
            if kind:
                spans.append((at, at + len(item), kind))
            text += " " + _prose(rng, rng.randint(0, 5), letters, mark)
        # a name that stands right behind a sentence belongs to the address before the @, as the fixed pattern takes it
        yield text[:128], [(a, min(b, 128), k) for a, b, k in spans if a < 128]
