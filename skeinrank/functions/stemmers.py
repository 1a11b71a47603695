"""Snowball stemmers for French, German and Spanish, written from their published descriptions, and short stop lists."""

from __future__ import annotations

import re

# Function words that carry no topic.
FRENCH_STOP = frozenset(
    "au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une "
    "vos votre vous c d j l à m n s t y été étée étées étés étant suis es est sommes êtes sont serai sera seront étais était étions étiez étaient fus fut soit ai as avons avez ont aura avais avait eu".split()
)
GERMAN_STOP = frozenset(
    "aber alle allem allen aller alles als also am an ander andere anderem anderen anderer anderes auch auf aus bei bin bis bist da damit dann der den des dem die das dass daß derselbe dieselbe dasselbe dazu "
    "dein deine deinem deinen deiner denn derer dessen dich dir du dies diese diesem diesen dieser dieses doch dort durch ein eine einem einen einer eines einig einige er ihn ihm es etwas euer eure für gegen "
    "gewesen hab habe haben hat hatte hatten hier hin hinter ich mich mir ihr ihre ihrem ihren ihrer euch im in indem ins ist jede jedem jeden jeder jedes jene jenem jenen jener jetzt kann kein keine können "
    "machen man manche mein meine mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr sein seine sich sie ihnen sind so solche soll sollte sondern sonst über um und uns unser unter viel vom von vor "
    "während war waren warst was weg weil weiter welche wenn werde werden wie wieder will wir wird wirst wo wollen wollte würde würden zu zum zur zwar zwischen".split()
)
SPANISH_STOP = frozenset(
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les "
    "ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus "
    "ellas es soy eres somos sois son sea era eran fue fueron ser ha han he hemos haber había".split()
)


def _after(pattern: str, word: str, start: int = 0) -> int:
    m = re.compile(pattern).search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


# ---- German

def german(word: str) -> str:
    v = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = re.sub(rf"(?<=[{v}])u(?=[{v}])", "U", w)
    w = re.sub(rf"(?<=[{v}])y(?=[{v}])", "Y", w)
    pair = rf"[{v}][^{v}]"
    r1 = _after(pair, w)
    r2 = _after(pair, w, r1)
    r1 = max(r1, min(3, len(w)))
    s = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= r1 and (s != "s" or re.search(r"[bdfghklmnrt]s$", w)):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = _longest(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= r1 and (s != "st" or re.search(r"...[bdfghklmnt]st$", w)):
        w = w[: -len(s)]
    s = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= r2:
        cut = w[: -len(s)]
        if s in ("end", "ung"):
            w = cut
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
        elif s in ("ig", "ik", "isch"):
            w = w if cut.endswith("e") else cut
        elif s in ("lich", "heit"):
            w = cut
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = cut
            t = _longest(w, ("lich", "ig"))
            if t and len(w) - len(t) >= r2:
                w = w[: -len(t)]
    return w.translate(str.maketrans("äöüUY", "aouuy"))


# ---- Spanish

_ES_PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
_ES_Y = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
_ES_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera "
    "ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis "
    "ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def _romance_rv(w: str, v: str) -> int:
    """Start of RV: by the second letter, else the third."""
    if len(w) < 3:
        return len(w)
    if w[1] not in v:
        return _after(rf"[{v}]", w, 2)
    if w[0] in v:
        return _after(rf"[^{v}]", w, 2)
    return 3


def spanish(word: str) -> str:
    v = "aeiouáéíóúü"
    w, plain = word, str.maketrans("áéíóú", "aeiou")
    pair = rf"[{v}][^{v}]"
    r1 = _after(pair, w)
    r2, rv = _after(pair, w, r1), _romance_rv(w, v)
    inside = lambda s, r: len(w) - len(s) >= r
    s = _longest(w, _ES_PRONOUNS)
    if s:
        stem = w[: -len(s)]
        t = _longest(stem, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if t and len(stem) - len(t) >= rv and (t != "yendo" or stem.endswith("uyendo")):
            w = stem[: -len(t)] + (t.translate(plain) if t in ("iéndo", "ándo", "ár", "ér", "ír") else t)
    before = w
    groups = {
        "drop": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
        "ic": "adora ador ación adoras adores aciones ante antes ancia ancias acion".split(), "log": "logía logías".split(), "u": "ución uciones".split(),
        "ente": "encia encias".split(), "amente": ["amente"], "mente": ["mente"], "idad": "idad idades".split(), "iv": "iva ivo ivas ivos".split(),
    }
    s = _longest(w, [x for g in groups.values() for x in g])
    if s:
        kind = next(k for k, g in groups.items() if s in g)
        if kind == "amente":
            if inside(s, r1):
                w = w[: -len(s)]
                t = _longest(w, ("iv", "os", "ic", "ad"))
                if t and inside(t, r2):
                    w = w[: -len(t)]
                    if t == "iv" and w.endswith("at") and inside("at", r2):
                        w = w[:-2]
        elif inside(s, r2):
            w = w[: -len(s)] + {"log": "log", "u": "u", "ente": "ente"}.get(kind, "")
            more = {"ic": ("ic",), "mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "iv": ("at",)}.get(kind, ())
            t = _longest(w, more)
            if t and inside(t, r2):
                w = w[: -len(t)]
    if w == before:
        s = _longest(w[rv:], _ES_Y)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            s = _longest(w[rv:], [*_ES_VERBS, "en", "es", "éis", "emos"])
            if s:
                w = w[: -len(s)]
                if s in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    s = _longest(w, ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if s and inside(s, rv):
        w = w[: -len(s)]
        if s in ("e", "é") and w.endswith("gu") and inside("u", rv):
            w = w[:-1]
    return w.translate(plain)


# ---- French

_FR_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def french(word: str) -> str:
    v = "aeiouyâàëéêèïîôûù"
    w = re.sub(rf"(?<=[{v}])u(?=[{v}])", "U", word)
    w = re.sub(rf"(?<=[{v}])i(?=[{v}])", "I", w)
    w = re.sub(rf"(?<=[{v}])y|y(?=[{v}])", "Y", w)
    w = w.replace("qu", "qU")
    pair = rf"[{v}][^{v}]"
    if re.match(rf"[{v}]{{2}}", w) or w.startswith(("par", "col", "tap")):
        rv = 3
    else:
        rv = _after(rf"[{v}]", w, 1)
    r1 = _after(pair, w)
    r2 = _after(pair, w, r1)
    at = lambda s, r: w.endswith(s) and len(w) - len(s) >= r
    start, verbs = w, False
    groups = {
        "drop": "ance iqUe isme able iste eux ances iqUes ismes ables istes".split(), "ic": "atrice ateur ation atrices ateurs ations".split(), "log": "logie logies".split(),
        "u": "usion ution usions utions".split(), "ent": "ence ences".split(), "ement": "ement ements".split(), "ité": "ité ités".split(), "if": "if ive ifs ives".split(), "eaux": ["eaux"], "aux": ["aux"],
        "euse": "euse euses".split(), "issement": "issement issements".split(), "amment": ["amment"], "emment": ["emment"], "ment": "ment ments".split(),
    }
    s = _longest(w, [x for g in groups.values() for x in g])
    if s:
        kind, stem = next(k for k, g in groups.items() if s in g), w[: -len(s)]
        in_r2, in_r1, in_rv = len(stem) >= r2, len(stem) >= r1, len(stem) >= rv
        if kind in ("drop", "log", "u", "ent") and in_r2:
            w = stem + {"log": "log", "u": "u", "ent": "ent"}.get(kind, "")
        elif kind == "ic" and in_r2:
            w = stem
            if w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif kind == "ement" and in_rv:
            w = stem
            if at("iv", r2):
                w = w[:-2]
                if at("at", r2):
                    w = w[:-2]
            elif at("eus", r2):
                w = w[:-3]
            elif at("eus", r1):
                w = w[:-1] + "x"
            elif at("abl", r2) or at("iqU", r2):
                w = w[:-3]
            elif at("ièr", rv) or at("Ièr", rv):
                w = w[:-3] + "i"
        elif kind == "ité" and in_r2:
            w = stem
            if w.endswith("abil"):
                w = w[:-4] if len(w) - 4 >= r2 else w[:-2] + "l"
            elif w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
            elif at("iv", r2):
                w = w[:-2]
        elif kind == "if" and in_r2:
            w = stem
            if at("at", r2):
                w = w[:-2]
                if w.endswith("ic"):
                    w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif kind == "eaux":
            w = w[:-1]
        elif kind == "aux" and in_r1:
            w = w[:-2] + "l"
        elif kind == "euse" and (in_r2 or in_r1):
            w = stem if in_r2 else stem + "eux"
        elif kind == "issement" and in_r1 and stem and stem[-1] not in v:
            w = stem
        elif kind in ("amment", "emment") and in_rv:
            w, verbs = stem + ("ant" if kind == "amment" else "ent"), True
        elif kind == "ment" and stem and stem[-1] in v and len(stem) - 1 >= rv:
            w, verbs = stem, True
    if w == start or verbs:
        changed = w
        s = _longest(w[rv:], _FR_I)
        if s and len(w) - len(s) > rv and w[len(w) - len(s) - 1] not in v:
            w = w[: -len(s)]
        if w == changed:
            s = _longest(w[rv:], [*_FR_E, *_FR_A, "ions"])
            if s == "ions":
                w = w[: -len(s)] if len(w) - len(s) >= r2 else w
            elif s:
                w = w[: -len(s)]
                if s in _FR_A and w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
        residual = w == changed
    else:
        residual = False
    if not residual:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if len(w) > 1 and w.endswith("s") and w[-2] not in "aiouès":
            w = w[:-1]
        s = _longest(w[rv:], ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"))
        if s == "ion":
            if len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st":
                w = w[:-3]
        elif s in ("ier", "ière", "Ier", "Ière"):
            w = w[: -len(s)] + "i"
        elif s == "e" or (s == "ë" and w.endswith("guë")):
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(rf"[éè](?=[^{v}]+$)", "e", w)
    return w.lower()
