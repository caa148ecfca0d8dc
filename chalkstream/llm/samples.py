"""Invented labelled documents from which the rules for kinds of text are learned."""

from __future__ import annotations

import random

_SUBJECTS = "the class;a visitor;my neighbour;the whole team;one of the teachers;our group;the older child;nobody in the room;the author;her brother".split(";")
_VERBS = "noticed that;explained why;asked whether;could not say how;was sure that;wrote down that;hoped that;had forgotten how;told us that;wondered if".split(";")
_CLAUSES = (
    "the answer was too large;it would rain before the end of the week;the bus had left without them;this rule works for every number;there is more than one way to do it;"
    "the shop on the corner sells bread and milk;we should begin with a drawing;they had to share what was left;the price of 12 tickets is 84;half of the water is gone after 20 minutes;"
    "you can add 7 to both sides;it is not as hard as it looks;she has been waiting for an hour;the two lines never meet;a third of the money was spent on paint;he worked alone and only asked for help once;they share the cakes at home;in terms of time it is the same;you should turn to the next page and search for the word;please read more at home;"
    "we print the sheet so that nobody has to share;the menu of the cafe was too long;this helps to see the pattern;a good first step is to check the units;children often assume that it must get bigger"
).split(";")
_STARTS = "After lunch;In the end;For this reason;At first;On Monday;To be fair;As you can see;With a little help;By then;Of course".split(";")
_FOREIGN = [
    "Nous avons passé une heure sur ce problème et la réponse est juste.;Il faut que les élèves lisent la question avant de répondre.;Dans ce livre on trouve des exemples pour chaque règle.;Elle a dit que le train est parti à 8 heures.;Les résultats de la semaine sont meilleurs que ceux du mois dernier.",
    "Wir haben heute eine Stunde lang gerechnet und viel gelernt.;Die Lösung ist richtig, aber der Weg dorthin war zu lang.;Am Anfang sollte man die Frage genau lesen.;Das Kind hat gesagt, dass es die Regel nicht kennt.;Für morgen bleiben noch 14 Aufgaben, die wir gemeinsam lösen werden.",
    "La profesora dijo que la respuesta no era correcta.;En esta clase hemos hablado de los números y de las figuras.;Hay que leer la pregunta con calma antes de escribir.;El resultado es de 25 puntos para cada grupo.;Los alumnos trabajaron por parejas durante una hora.",
    "În această lecție am vorbit despre numere și despre figuri.;Elevul a spus că nu știe de ce trebuie să împartă la 4.;Pentru săptămâna viitoare au rămas 20 de exerciții.;La sfârșit fiecare a explicat regula cu propriile cuvinte.;Răspunsul este corect, dar drumul a fost prea lung.",
    "La lezione di oggi è stata molto utile per tutti.;Non so perché il risultato sia così grande.;Abbiamo letto la domanda e poi abbiamo fatto un disegno.;I ragazzi hanno detto che la regola è facile.",
    "Wat een mooie oplossing heb je gevonden voor deze som.;De kinderen hebben een uur gewerkt en het antwoord is goed.;We moeten eerst de vraag lezen en dan pas rekenen.;Het is niet zo moeilijk als het lijkt.",
]
#: Real words that look unreal by their letters, as prose has now and then.
_RARE = "rhythm lengths twelfths matchsticks Christmas nth hmm Mr PDF 2nd 8pm 3rd Fortschritt überschlagen selbstständig entspricht Geschichtsstunde Herbstschule Angstschrei schwyzerdütsch Krzysztof Åsbjørn McNab iPad e.g.this YouTube well,then zwölftens sechzehn sightseeing backstroke worthwhile".split()
_NOUNS = "line point apple river garden table engine window market letter bridge forest pencil winter basket corner planet stone copper violin rocket saddle harbour island candle mirror ladder blanket kettle orange factor median vertex ratio square angle cube".split()
_NAV = "About us;Careers;Sitemap;Newsletter;Register;My account;Basket;Checkout;FAQ;Support centre;Follow us;Settings;Dashboard;Log out;Home;Search site;Privacy notice;Terms of use;Cookie settings;Download app;Read more;Next page;Share this;Help".split(";")
_BULLETS = ["- ", "* ", "• ", "– ", "» ", "☐ ", "{n}. ", "{n}) ", "({n}) ", "{a}) ", "{a}. ", "{n} marks - ", "{n} mark - ", "", ""]
_HEADS = ["Words of the week", "Checklist:", "Remember to pack", "Agenda", "Taken from the board.", "Scores so far:", "Equipment", "Before Friday:", ""]


def _sentence(r: random.Random) -> str:
    s = f"{r.choice(_SUBJECTS)} {r.choice(_VERBS)} {r.choice(_CLAUSES)}"
    if r.random() < 0.4:
        s += f", {r.choice(['and', 'but', 'so', 'because', 'although'])} {r.choice(_CLAUSES)}"
    if r.random() < 0.3:
        s = f"{r.choice(_STARTS)}, {s}"
    return s[0].upper() + s[1:] + r.choice(["."] * 8 + ["!", "?"])


def _sums(r: random.Random) -> str:
    a, b = r.randrange(2, 60), r.randrange(2, 60)
    return r.choice([f"So {a} × {b} = {a * b}, and {a * b} ÷ {a} = {b}.", f"Then we get x = {a} and from this it follows that 2x + {b} = {2 * a + b}.", f"The sum of {a} and {b} is {a + b}, which is what we wanted."])


def prose(r: random.Random, size: int) -> str:
    pool = r.choice(_FOREIGN).split(";") if r.random() < 0.3 else None
    out: list[str] = []
    while sum(map(len, out)) < size:
        out.append(r.choice(pool) if pool else _sums(r) if r.random() < 0.12 else _sentence(r))
    form = r.random()
    if r.random() < 0.6:
        out = [s if r.random() < 0.7 else s.replace(" ", f" {r.choice(_RARE)} ", 1) for s in out]
    if r.random() < 0.05:
        out = [s.replace("e", r.choice(["Ã©", "\ufffd", "e"]), 1) for s in out]
    if form < 0.15:
        return "\n".join(f"{r.choice(['Tutor', 'Pupil', 'A', 'B'])}{sep} {s}" for sep in [r.choice([":", " -"])] for s in out)
    text = r.choice([" ", " ", " ", "\n", "\n\n", " \n"]).join(out)
    if form < 0.3:
        text = "".join(c for c in text.lower() if c.isalnum() or c in " \n'")
    elif form < 0.4:
        text = text.upper()
    elif form < 0.55:
        width, lines = r.randrange(24, 60), [""]
        for w in text.split():
            if len(lines[-1]) + len(w) > width:
                lines.append("")
            lines[-1] += w + " "
        text = "\n".join(r.choice(["", "> "][: 1 + (form < 0.46)]) + x.strip() for x in lines)
    elif form < 0.62:
        words = text.split()
        r.shuffle(words)
        text = " ".join(words)
    return text


def listing(r: random.Random, size: int) -> str:
    entry = r.choice(
        [
            lambda: r.choice(_NOUNS), lambda: f"{r.choice(_NOUNS)} {r.choice(_NOUNS)} ({r.randrange(5, 40)} min)", lambda: f"{r.choice(_NOUNS)}: {r.choice(_NOUNS)} {r.randrange(40)}",
            lambda: f"{r.choice(['bring', 'check', 'print', 'order'])} the {r.choice(_NOUNS)} {r.choice(_NOUNS)}s", lambda: f"{r.randrange(99)} {r.choice('+-×÷')} {r.randrange(99)} =", lambda: f"{r.choice(_NOUNS)} {r.choice(_NOUNS)}",
        ]
    )
    head = r.choice(_HEADS)
    if r.random() < 0.25:
        sep = r.choice([", ", "; ", " / ", " · "])
        out: list[str] = []
        while sum(map(len, out)) < size:
            out.append(entry())
        return (head + " ") * bool(head) + sep.join(out)
    bullet, out, n = r.choice(_BULLETS), [head] * bool(head), 0
    while sum(map(len, out)) < size:
        n += 1
        out.append(bullet.format(n=n if "mark" not in bullet else r.randrange(1, 10), a=chr(96 + (n - 1) % 26 + 1)) + entry())
    return "\n".join(out)


def table(r: random.Random, size: int) -> str:
    n = r.randrange(3, 7)
    kinds = [r.choice([lambda: str(r.randrange(1000)), lambda: f"{r.random() * 100:.1f}", lambda: f"2031-0{r.randrange(1, 10)}-{r.randrange(10, 29)}", lambda: r.choice(["yes", "no", "n/a", ""]), lambda: r.choice(_NOUNS)]) for _ in range(n)]
    rows = [[r.choice(_NOUNS) for _ in range(n)]]
    while sum(sum(map(len, x)) + 3 * n for x in rows) < size:
        rows.append([k() for k in kinds])
    form = r.choice(["pipe", "bare", "tab", "comma", "semi", "wide", "box"])
    if form in ("pipe", "bare"):
        out = ["| " + " | ".join(x) + " |" for x in rows]
        out[1:1] = ["|" + "---|" * n] * (form == "pipe")
    elif form == "wide":
        out = ["".join(c.ljust(16) for c in x).rstrip() for x in rows]
    elif form == "box":
        bar = "+" + "+".join("-" * 14 for _ in range(n)) + "+"
        out = [bar, *["|" + "|".join(c.rjust(14) for c in x) + "|" for x in rows], bar]
    else:
        out = [{"tab": "\t", "comma": ",", "semi": ";"}[form].join(x) for x in rows]
    head = r.choice(_HEADS)
    return "\n".join([head] * bool(head) + out)


def junk(r: random.Random, size: int) -> str:
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n, alphabet: "".join(r.choice(alphabet) for _ in range(n))
    form = r.randrange(13)
    if form == 0:
        return " ".join(word(r.randrange(2, 14), letters) for _ in range(size // 8))
    if form == 1:
        return word(size, letters + letters.upper() + "0123456789+/") + "=="
    if form == 2:
        return r.choice([" ", "\n", ""]).join([r.choice(["next", "test", "loading", "null", "the the", "and", "aaa", "click here", "lorem ipsum", "..."])] * (size // 6))
    if form == 3:
        return "".join(f'<{t} class="c{r.randrange(99)}"><span id={r.randrange(999)}></span></{t}>{{margin:{r.randrange(9)}px;}}' for t in [r.choice(["div", "td", "li"]) for _ in range(size // 60 + 1)])
    if form in (4, 5):
        return r.choice([" | ", " » ", "\n", " ", " - "]).join(r.choice(_NAV) for _ in range(size // 9 + 2))
    if form == 6:
        return " ".join(f"0x{r.randrange(65536):04x}" for _ in range(size // 7 + 1))
    if form == 7:
        return "".join(r.choice("!#$%&*+,-./:;<=>?@^_|~\\ ") for _ in range(size))
    if form == 8:
        bad = prose(r, size).encode("utf-8").decode("latin-1")
        return "".join(r.choice(["Ã¢â‚¬", "Ã©", "Â", "�", "Ã¼"]) if r.random() < 0.3 else c for c in bad)
    if form in (9, 10):
        return " ".join("".join(r.sample(w, len(w))) if r.random() < 0.8 else w for w in prose(r, size).split(" "))
    if form == 11:
        return r.choice(["", " ", "\n\n", "\xa0 \xa0"])
    return "".join(r.choice("�ÃÂ¤¶§±þ€™œ\x7f") for _ in range(size))


def labelled(n: int = 5000, seed: int = 11) -> list[tuple[str, str]]:
    """(text, kind): half plain, half mixed of prose and another kind, labelled by what is more than half."""
    r = random.Random(seed)
    makers = {"prose": prose, "list": listing, "table": table, "junk": junk}
    out = []
    for _ in range(n):
        kind = r.choice(["prose", "prose", "list", "table", "junk"])
        size = int(r.choice([60, 150, 400, 900, 1800]) * (0.6 + r.random()))
        text = makers[kind](r, size)
        if kind != "junk" and r.random() < 0.4:
            other = r.choice(["list", "table"]) if kind == "prose" else "prose"
            parts = [text, makers[other](r, int(max(30, len(text)) * r.uniform(0.1, 0.75)))]
            if len(parts[1]) < 0.9 * len(parts[0]):
                r.shuffle(parts)
                text = "\n".join(parts)
        out.append((text, kind))
    return out
