"""Invented utterances with marked personal information, and others that only look like it."""

from __future__ import annotations

import random
import re

from chalkstream.llm.personal import _SMALL, _TENS, DIGITS, GIVEN

#: Made of parts, so that no family is a list: heads and tails of family names and streets, plain family names, hosts.
_HEAD = "Brack Cald Dunn Ever Far Gold Hart Ing Jar Kirk Lang Mill Nor Old Pem Rad Sel Tur Under Ver Wal York Abb Bol Cro Dray Eck Fitz Grim Hux Ir Kel Lor Mar Nes Osk Pres Quil Ros Stan Thel Ul Vin Whit Zim".split()
_TAIL = "field ford ley man well wood son wright brook smith er ing stead ard ett kins low win den croft mere vale wick over burn ski enko ez idis ovic nen ura oglu eira elli".split()
_PLAIN_FAMILY = "Smith Brown Walker Green Khan Hill Jones Taylor Wilson Evans Patel Singh Chen Wang Garcia Nguyen Silva Okafor Mensah Ali Hussain Novak Rossi Müller Dubois Jensen Yamamoto Kim Park Baker Cook Young King Wright Cooper Ward Wood Bell Murphy Kelly Gray Reed Fox Rice".split()
_STREET_HEAD = "Acacia Beech Canal Chestnut Dove Elder Fern Granary Harbour Ivy Kestrel Laurel Manor North Oakdale Priory Quarry Rectory Spring Thistle Union Victoria Willow Windmill Albert George Market Bishop Chapel Mount Grange Poplar Sycamore Heron Clover".split()
_STREET_TAIL = ["", "", "", "dale", "wick", "stone", "lea", "hurst", "ton", "side", "brook", "mead", "head", "ford"]
_FULL = "Street Road Avenue Lane Drive Close Way Court Mews Parade Hill Gardens Crescent Terrace Boulevard Walk Row Rise Grove Place".split()
_SHORT = "St Rd Ave Ln Dr Cres Blvd St. Rd. Ave. Gdns Terr".split()
_HOSTS = "post letterbox inbox bluemail greenpost northgate-college hilltop-primary classlink studypoint homework-hub sunmail parkside students staff family7 year11 webpost".split()
_TLDS = "com org net test invalid example co.uk sch.uk edu ac.uk info".split()
_PLAIN = (
    "could you repeat the last bit;I got three quarters;now the ratio becomes 4:5;start by dividing by 8;oh I see it now;I make it 39;there were 23 squares in the row;could it be 81?;the page will not load;where did the 6 come from?;right, I will have a go;"
    "shall we look at percentages again;tell me what you see in the chart;it measures 52 mm by 19 mm;a third of 72;y is 11;lovely, and after that?;this part confuses me"
).split(";")
#: Given names beside the listed ones, also made of parts, so that being listed is no more than a hint.
_GIVEN_HEAD = "Al Ber Cor Del Ed Fer Gar Hol Ish Jan Kel Lor Mar Nad Ol Per Ros Sher Tam Ul Ver Wil Xan Yas Zel Ade Chi Oba Thu Vik Ngo Kwa".split()
_GIVEN_TAIL = "an bert dra eth ia ine iel ka leen mond na olu ra ric sha tia von win wyn yn ita esh ami oro".split()
_GIVEN_MORE = "Gareth Kevin Stephen Margaret Patricia Brian Keith Donna Sharon Tracey Wayne Craig Neil Graham Wei Li Ming Ravi Anil Sunita Deepak Pooja Olga Ivan Sergei Pavel Marek Piotr Ingrid Lars Sven Pierre Chantal Jacques Carmen Pablo Rosario Giulia Marco Ahmad Khalid Yasmin Hamza Chidi Amina Kofi Ama".split()


def given(r: random.Random) -> str:
    x = r.random()
    return r.choice(GIVEN).title() if x < 0.45 else r.choice(_GIVEN_MORE) if x < 0.7 else r.choice(_GIVEN_HEAD) + r.choice(_GIVEN_TAIL)


def _digit_words(r: random.Random, digits: str) -> str:
    names = {v: k for k, v in DIGITS.items() if len(k) > 1 and k != "nought"}
    oh, double, out, i = r.random() < 0.5, r.random() < 0.7, [], 0
    while i < len(digits):
        d = digits[i]
        word = ("oh" if oh else "zero") if d == "0" else names[d]
        if double and digits[i : i + 2] == d * 2:
            out.append(f"double {word}")
            i += 2
        else:
            out.append(word)
            i += 1
    return " ".join(out)


def _n(r: random.Random, k: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(k))


def _number_words(r: random.Random) -> str:
    return r.choice([r.choice(_SMALL), f"{r.choice(_TENS)} {r.choice(_SMALL[:9])}", f"{r.choice(_TENS)}-{r.choice(_SMALL[:9])}", f"a hundred and {r.choice(_SMALL)}"])


def family(r: random.Random) -> str:
    f = r.choice(_HEAD) + r.choice(_TAIL)
    x = r.random()
    return f"O'{f}" if x < 0.07 else f"{r.choice(['Mac', 'Mc'])}{f}" if x < 0.13 else f"{r.choice(['van der', 'de', 'von', 'al', 'di'])} {f}" if x < 0.2 else f"{f}-{r.choice(_HEAD)}{r.choice(_TAIL)}" if x < 0.27 else r.choice(_PLAIN_FAMILY) if x < 0.5 else f


def _cased(r: random.Random, x: str) -> str:
    k = r.random()
    return x.lower() if k < 0.22 else x.upper() if k < 0.27 else x


def email(r: random.Random) -> tuple[str, str]:
    g, f = given(r).lower(), r.choice(_HEAD).lower() + r.choice(_TAIL)
    local = r.choice([f"{g}.{f}", f"{g}{r.randrange(99)}", f"{g[0]}.{f}", f"{g[0]}{f}", f"{g}-{f}{r.randrange(9)}", f"{f}_{g}", f"the{f}family", f"{g}.{f}+maths"])
    domain = r.choice(["", "mail.", "pupils."]) + r.choice(_HOSTS) + "." + r.choice(_TLDS)
    k = r.random()
    if k < 0.4:
        out = f"{local}@{domain}"
    elif k < 0.5:
        out = f"{local} @ {domain}"
    elif k < 0.6:
        a, d = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] ")])
        out = local + a + domain.replace(".", d)
    elif k < 0.7:
        out = f"mailto:{local}@{domain}" if r.random() < 0.5 else f"<{local}@{domain}>"
    else:
        say = {".": " dot ", "-": " dash ", "_": " underscore ", "+": " plus "}
        out = "".join(say.get(c, c) for c in local) + " at " + "".join(say.get(c, c) for c in domain)
    frame = r.choice(["you can email me at {}", "the account is {}", "please use {} for the sheet", "mail from {} never came", "{} works best for us", "my dad set up {} last year", "try {} instead", "I typed {} into the box", "{}", "{}", "reach us through {}"])
    return (out.title() if r.random() < 0.06 and "@" in out else out), frame


def phone(r: random.Random) -> tuple[str, str]:
    k = r.randrange(8)
    if k == 0:
        g = [r.choice(["1", ""]), r.choice("23456789") + _n(r, 2), r.choice("23456789") + _n(r, 2), _n(r, 4)]
        x = r.choice([f"({g[1]}) {g[2]}-{g[3]}", "-".join(filter(None, g)), ".".join(g[1:]), f"+1 {g[1]} {g[2]} {g[3]}"])
        digits = "".join(g)
    elif k == 1:
        g = ["04" + _n(r, 2), _n(r, 3), _n(r, 3)]
        x, digits = r.choice([" ".join(g), "+61" + "".join(g)[1:], f"+61 {g[0][1:]} {g[1]} {g[2]}"]), "".join(g)
    else:
        g = r.choice([["07" + _n(r, 3), _n(r, 3), _n(r, 3)], ["01" + _n(r, 3), _n(r, 3), _n(r, 3)], ["02" + r.choice("0389"), _n(r, 4), _n(r, 4)], ["01" + r.choice("23456789") + "1", _n(r, 3), _n(r, 4)], ["0" + r.choice(["800", "808", "300"]), _n(r, 3), _n(r, 4)]])
        digits = "".join(g)
        x = r.choice([" ".join(g), "".join(g), "-".join(g), ".".join(g), f"({g[0]}) {g[1]} {g[2]}", f"+44 {g[0][1:]} {g[1]} {g[2]}", "+44" + digits[1:], "0044" + digits[1:], f"+44 (0){g[0][1:]} {g[1]}{g[2]}"])
    if r.random() < 0.3:
        x = _digit_words(r, digits)
    return x, r.choice(["phone us on {}", "my mobile: {}", "you could ring {} tonight", "send a text to {}", "tel. {}", "the landline at home is {}", "{} is our phone", "there was a missed call from {}", "dial {} and ask", "{}", "{}"])


def id_number(r: random.Random) -> tuple[str, str]:
    k = r.randrange(6)
    if k == 0:
        a, d, z = r.choice("ABCEGHJKLMNOPRSTWXYZQ") + r.choice("ABCEGHJKLMNPRSTWXYZQ"), _n(r, 6), r.choice("ABCD")
        x = r.choice([a + d + z, f"{a} {d} {z}", f"{a} {d[:2]} {d[2:4]} {d[4:]} {z}", f"{a}-{d[:2]}-{d[2:4]}-{d[4:]}-{z}"])
        frame = ["the national insurance no. on the letter says {}", "her NI number: {}", "his NI number is {}", "payroll has me as {}", "insurance number {}", "nino {}", "they need my NI which is {}", "{}"]
    elif k == 1:
        a, b, c = _n(r, 3), _n(r, 2), _n(r, 4)
        x = r.choice([f"{a}-{b}-{c}", f"{a} {b} {c}"])
        frame = ["social security no. {}", "his SSN: {}", "for the social security box I wrote {}", "my social, {}, was refused", "{}"]
    elif k == 2:
        d = _n(r, 10)
        x = r.choice([d, f"{d[:3]} {d[3:6]} {d[6:]}", _digit_words(r, d)])
        frame = ["the hospital letter says NHS number {}", "NHS no. {}", "his NHS number is {}", "the NHS number is {} then", "my health number: {}", "the doctor typed {} for my NHS record", "patient number {}"]
    elif k in (3, 4):
        a, d = r.choice("ABCDEFGHJKLMNPQRTUVWXYZIOS"), _n(r, 12)
        x = r.choice([a + d, f"{a} {d[:4]} {d[4:8]} {d[8:]}", f"{a}{d[:3]}-{d[3:8]}-{d[8:]}"])
        frame = ["UPN: {}", "on my report the pupil number is {}", "the office keeps {} as my pupil id", "unique pupil number {}", "I sign in as {}, that is my student number", "learner no. {}", "{}"]
    else:
        x = r.choice([f"{r.choice('ABCEHKLMPXYZ')}{r.choice('ABCEHKLMPXYZ')}{_n(r, 7)}", _n(r, 9), f"{r.choice('ABCLKEPX')}{_n(r, 8)}", _digit_words(r, _n(r, 9))])
        frame = ["passport: {}", "the number in her passport is {}", "her passport number is {}", "the travel form needs a passport no., {}", "my old passport was {}", "a passport ending like {}"]
    return (x.lower() if r.random() < 0.1 else x), r.choice(frame)


def address(r: random.Random) -> tuple[str, str]:
    name = r.choice(_STREET_HEAD) + r.choice(_STREET_TAIL) if r.random() < 0.6 else r.choice(_HEAD) + r.choice(_STREET_TAIL[2:])
    if r.random() < 0.15:
        name = f"{r.choice(['Old', 'Great', 'Upper', 'Lower', 'Saint'])} {name}"
    no = r.choice([str(r.randrange(1, 240)), str(r.randrange(1, 240)), f"{r.randrange(1, 90)}{r.choice('abc')}", str(r.randrange(1000, 9000)), _number_words(r)])
    x = f"{no}{r.choice([' ', ' ', ' ', ', '])}{name} {r.choice(_FULL if r.random() < 0.75 else _SHORT)}"
    k = r.random()
    if k < 0.15:
        x = f"number {no} on {name} {r.choice(_FULL)}"
    elif k < 0.27:
        x = f"flat {r.randrange(1, 30)}, {x}"
    x = _cased(r, x)
    return x, r.choice(["we live in {}", "my house is {}", "home is {} now", "send the letter to {}", "my gran stays at {}", "we are moving to {} soon", "the taxi came to {}", "please post it to {}", "on the envelope it says {}", "there is a party at {} on Friday", "{}", "{}", "{}, by the bakery", "{} is our home"])


def name(r: random.Random) -> tuple[str, str]:
    if r.random() < 0.3:
        x = f"{r.choice(['Mr', 'Mrs', 'Ms', 'Miss', 'Dr', 'Prof'])}{r.choice(['', '', '.'])} {family(r)}"
        return _cased(r, x), r.choice(["our maths teacher {} said so", "I am in the class of {}", "{} wants it by Friday", "please ask {} first", "{} showed us another way", "the letter is from {}", "thank you {}", "we had {} yesterday", "{}"])
    g = given(r)
    if r.random() < 0.15:
        g += f" {r.choice('ABCDEJKLMPRST')}{r.choice(['', '.'])}"
    x = f"{g} {family(r)}"
    frame = r.choice(["my name is {}", "hello, I am {}", "I'm {} and I am new", "this is {}", "my cousin {} showed me", "{} sits next to me", "so {} you go first", "is that {} on the line", "can {} join us", "goodbye {}", "thank you {}", "yours, {}", "they call her {}", "{} told me to multiply", "please ask {} to mute", "her mother is {}", "{} has the other sheet", "it belongs to {}", "I work with {} on Mondays", "well done {}", "{}", "the winner was {}"])
    if r.random() < 0.5:
        opener = r.choice(["", "", "Then", "Today", "I think", "maybe", "Later", "I guess", "On Tuesday", "In class", "Listed under", "Entered as", "After lunch", "Perhaps", "Because", "Sometimes", "Next to", "We saw", "They sent"])
        frame = f"{opener} {{}} {r.choice(['', '', 'explains it', 'knew this', 'went first', 'came in', 'can help', 'sent the sheet', 'likes graphs', 'wrote it down', 'is here', 'was right', 'will call', 'and the others', 'has a question', 'taught us', 'for the quiz'])}".strip()
    if r.random() < 0.12:
        x, frame = f"{family(r)}, {g.split()[0]}", r.choice(["the list says {}", "registered as {}", "the screen has {} at the top", "{}"])
    # a name in lower case that is neither listed nor introduced looks like any two words: nobody could tell
    known = any(g.split()[0].lower() == k for k in GIVEN) or re.search(r"(?:name is|I am|I'm|this is) \{\}", frame)
    return _cased(r, x) if known else x, frame


def lookalike(r: random.Random) -> str:
    """Nothing personal, though near it in form."""
    g, h, f = given(r), given(r), r.choice(_HEAD) + r.choice(_TAIL)
    street = f"{r.choice(_STREET_HEAD)}{r.choice(_STREET_TAIL)} {r.choice(_FULL)}"
    noun = r.choice("scale fraction chart triangle graph mean digit angle square term mode".split())
    thing = r.choice("Key Stage;Year Seven;Venn Diagram;Bar Chart;Monday Morning;Great Britain;United Kingdom;Tower Bridge;World Cup;Good Morning;Well Done;Star Wars;Pythagoras Theorem;Times Table;Google Classroom;Big Ben;New York;North Sea;Red Team;Part Two;Question Three;Hollow Bridge;Lake District;Black Friday;Roman Numerals;Number Line".split(";"))
    do = r.choice("thinks has draws buys gets needs pays runs walks shares counts wants reads picks owns says makes".split())
    after = r.choice("what now let perfect okay so could we the that can you it is try look right yes no and great".split())
    a, b = r.randrange(2, 99), r.randrange(2, 99)
    x = r.choice(
        [
            f"my name is {g}", f"hello {g}, how are you today?", f"can {g} join us", f"thank you {g} {after} we go on", f"okay {g} {after}", f"lovely {g}, {after} next", f"{g} {do} {a} apples", f"{g} and {h} split {a} sweets", f"{g} sits by the window", f"well done {g}! {after.title()} about part two",
            f"what does {g} {do[:-1]}", f"{g}'s {r.choice(['bag', 'answer', 'ruler', 'brother'])} is here", f"this is {g}", f"my cousin {g} showed me", f"please ask {g} {after}", f"Okay {g} {r.choice(_PLAIN)}", f"Right {g}, {r.choice(_PLAIN)}", f"Great {g} {after}", f"Hi {g}, {h} is late", f"bye {g} {after}", f"I think {g} {do} more", f"so {g} {do} it",
            f"excellent, {r.choice(['um', 'erm', 'uh'])}, {g}", f"ask {g} or {h}", f"{g}, {h} and I are here", f"{g} {thing.split()[0].lower()} first", f"Ready {g}? {after.title()} try it", f"Hello {r.choice(['um', 'er'])} {g}", f"is {g} right", f"Thanks {g}. {after.title()} see",
            f"{r.choice(['Then', 'Today', 'I think', 'Later', 'On Tuesday', 'After lunch', 'Perhaps', 'We saw'])} {r.choice([g, thing])} {r.choice(['went first', 'came in', 'is here', 'was right', 'will help', 'and the others', 'has a question'])}", f"{r.choice(['Then', 'Today', 'Later', 'Yes', 'Perhaps'])} {g} {after}",
            thing, f"we did {thing} before", f"{thing} is in the book", f"look at the {thing}", f"the {thing} has {a} parts", f"{g} {r.choice(['Road', 'Bridge', 'Park', 'Street', 'School'])} is on the map", f"{f} {r.choice(['Academy', 'College', 'Station', 'Hall'])}", f"Write It Down, {after.title()} {noun.title()}", f"Find The {noun.title()} Of The {thing}", f"{thing.upper()} TODAY",
            "Dear Sir or Madam", "yes sir, nearly", "miss, is it break", "we miss you", "sir, look", "the doctor says rest", "Mr and Mrs are short forms", "sir says it is fine", f"sir {do} the board", f"miss {do} us {a}", f"sir {r.choice(['checked', 'drew', 'told', 'gave', 'put', 'asked'])} it {after}", f"miss {r.choice(['checked', 'drew', 'told', 'gave', 'put', 'asked'])} me {after}", f"the doctor {do} {a}", f"can you show {g} I am done", f"can {g} tell {h} we won", "a miss is as good as a mile", f"dr is short for drive {a}",
            f"it is {a} km from {street} to the school", f"a bus leaves {street} at {a % 12 + 1} pm", f"{a} cars pass along {street} in {b} minutes", f"which houses on the street are even, {a} or {b}", f"{a} {noun} cards and {b} way signs", f"{a} {noun} {r.choice(['Drive', 'Way', 'Square', 'Place', 'Hill', 'Row', 'Rise', 'Close', 'Lane'])} {r.choice(['cards', 'tiles', 'tokens', 'counters', 'points', 'games', 'badges'])} and {b} more", f"a {a} minute walk down the lane", f"{a} km of road at {b} km an hour", f"question {a} is on the way", f"give it to {r.choice(_SMALL)} decimal place", f"to {r.choice(_SMALL)} decimal place, {a}", f"{a}.{b} to one {noun} place", f"there is {r.choice(_SMALL)} more way", f"move {r.choice(_SMALL)} {noun} row", f"{r.choice(_SMALL)} by {r.choice(_SMALL)} square", f"take {a} times {b} then square it", f"I walk along {street}", f"draw {a} squares in a row",
            f"is {_n(r, 3)} {_n(r, 3)} {_n(r, 4)} {r.choice(['even', 'odd', 'prime', f'a multiple of {a}', f'a factor of {b}', f'divided by {a} a whole number'])}", f"does {_n(r, 3)} {_n(r, 3)} {_n(r, 4)} divide by {a}", f"can you halve {_n(r, 3)} {_n(r, 3)} {_n(r, 4)}", f"{_n(r, 3)} {_n(r, 3)} {_n(r, 4)} {r.choice('+-×÷')} {a}", f"is {_n(r, 10)} divisible by {a}", f"take {_n(r, 4)} {_n(r, 3)} {_n(r, 3)} from {_n(r, 5)} {_n(r, 3)} {_n(r, 3)}", f"the sequence {_n(r, 4)} {_n(r, 4)} {_n(r, 4)} goes on", f"write {a} {_n(r, 3)} {_n(r, 3)} as words", f"round {a}.{_n(r, 5)} to two decimal places", f"on {r.randrange(10, 28)}/0{r.randrange(1, 9)}/2031", f"divide {_n(r, 4)} by {_n(r, 2)}", f"add {_n(r, 3)} {_n(r, 3)} and {_n(r, 3)} {_n(r, 3)}", f"multiples are {a} {2 * a} {3 * a} {4 * a} {5 * a}", f"we count {_digit_words(r, '12345678'[: r.randrange(5, 9)])}", f"is {_n(r, 3)} {_n(r, 3)} {_n(r, 4)} a multiple of {a}",
            f"the digits {_digit_words(r, _n(r, 7))} are mixed up", f"the code is {_digit_words(r, _n(r, 4))}", f"a city of {r.randrange(1, 9)},{_n(r, 3)},{_n(r, 3)} people", f"which pupil number comes next, {a}", "the form wants a pupil number", f"pi goes 3.14159{_n(r, 5)}", f"{_n(r, 4)} - {_n(r, 4)} = {_n(r, 4)}", f"in total {_n(r, 6)} and then {_n(r, 7)}", f"what is {_n(r, 5)} times {_n(r, 3)}",
            f"{a} @ {b}p each", f"plot it at {a} dot {b}", f"the site is {r.choice(_HOSTS)} dot {r.choice(['example', 'com', 'org'])}", f"open www.{r.choice(_HOSTS)}.test page {a}", f"see {r.choice(_HOSTS)} dot com", "email is down today", "she wrote to [EMAIL] and [PHONE]", "the password is [REDACTED]", f"[NAME] has {a}", f"put a dot at {a} and one at {b}", "look at the dot on the axis", f"tag @{g.lower()} in it",
            f"the {f.lower()} puzzle", f"as {f.lower()} would", f"like in {f}", f"it shows {a} points", f"round {a}.{_n(r, 3)} to one place", f"{g} in my class", f"{g} was first",
        ]
    )
    return x.lower() if r.random() < 0.15 else x


_MAKERS = {"email": email, "phone": phone, "id_number": id_number, "address": address, "name": name}


def labelled(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans): spans are (kind, start, end)."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans = "", []
        for part in range(r.choice([1, 1, 2, 3])):
            text += r.choice([" ", ". ", ", ", " and ", "\n", " - ", "; "]) if part else ""
            k = r.random()
            if k < 0.22:
                text += r.choice(_PLAIN)
            elif k < 0.5:
                text += lookalike(r)
            else:
                kind = r.choice(list(_MAKERS))
                x, frame = _MAKERS[kind](r)
                before, _, after = frame.partition("{}")
                at = len(text) + len(before)
                core = x.removeprefix("mailto:").strip("<>")
                at += x.index(core)
                spans.append((kind, at, at + len(core)))
                text += before + x + after
        out.append((text, spans))
    return out
