"""Accuracy where frames, names, hosts and number ranges are none of those the models are fitted on."""

from chalkstream.llm.personal import KINDS, VOCABULARY, _ordinary, fitted, spans_of

NAMES = ["Desmond Achebe", "Ingeborg Hallström", "Tunde Bakare", "Siobhan Gallagher", "Rajesh Venkataraman", "Beatriz Carvalho", "Hiroshi Tanizaki", "Wendy Postlethwaite", "Clive Ramsbottom", "Anastasia Volkova"]
NAME_FRAMES = ["Yesterday {} explained it to the class.", "You will be paired up with {} today.", "Registered under {}", "I think {} knows the answer", "Her best mate is {}.", "Somebody called {} rang", "Hi, it's {}", "We met {} at the fair"]
PHONES = ["07911 123456", "0161 715 8823", "+44 7455 210 998", "(415) 867-5309", "0207 183 8750", "0845 046 0123"]
PHONE_FRAMES = ["You can call the office at {}", "Leave a voicemail on {}", "Try her mobile, {}", "If it breaks, phone {}"]
MAILS = ["d.achebe@orbitmail.io", "wendy_p77@riverbank.academy", "clive dot ramsbottom at tealmail dot com", "siobhan-g@gaelnet.ie"]
MAIL_FRAMES = ["Best to reach him at {}", "{} is the one to use", "My address for mail is {}", "Ask {} for a copy"]
HOMES = ["14 Penhaligon Street", "221b Carrow Road", "flat 3, 9 Tunstall Terrace", "seventy-two Bluebell Lane", "305 Marchmont Crescent"]
HOME_FRAMES = ["Bring it round to {} please", "We've lived at {} since May", "My address is {}", "Deliveries go to {}"]
IDS = ["JG 10 37 59 A", "943 476 5919", "H801200001001", "412-65-9087"]
ID_FRAMES = {"JG 10 37 59 A": "My national insurance number is {}", "943 476 5919": "NHS number: {}", "H801200001001": "UPN {}", "412-65-9087": "Social security number {}"}
NOTHING = [
    "The Eiffel Tower is taller than Big Ben.", "Year Nine have a test on Friday Morning", "Multiply 4512 by 17 and add 233", "There were 1204 people, then 380 left", "Siobhan knows the answer", "Rajesh, can you share your screen?", "Turn left on Carrow Road", "The ratio is 3:4:5",
    "Round 48.20731 to one decimal place", "Is 943 476 5918 even?", "A recipe needs 250 grams", "The code for the safe is 4 8 1 5", "Go to www.riverbank.academy", "Meet me at noon", "miss, I am stuck", "What is the Highest Common Factor?", "Two steps down the hill", "12 people live on the road", "Thanks Wendy, see you", "[NAME] rang [PHONE]",
]


def test_accuracy_elsewhere():
    rows = [("name", f.format(n)) for n in NAMES for f in NAME_FRAMES] + [("phone", f.format(p)) for p in PHONES for f in PHONE_FRAMES] + [("email", f.format(m)) for m in MAILS for f in MAIL_FRAMES] + [("address", f.format(h)) for h in HOMES for f in HOME_FRAMES] + [("id_number", ID_FRAMES[i].format(i)) for i in IDS]
    rows += [("", t) for t in NOTHING]
    got = [{k for _, _, k, _ in g} for g in spans_of([t for _, t in rows], fitted(), _ordinary(VOCABULARY))]
    for kind in KINDS:
        want, have = [k == kind for k, _ in rows], [kind in g for g in got]
        hit = sum(a and b for a, b in zip(want, have))
        wrong = [t for (k, t), g in zip(rows, got) if (k == kind) != (kind in g)]
        assert hit >= 0.9 * sum(want) and hit >= 0.9 * sum(have), (kind, hit, sum(want), sum(have), wrong)
