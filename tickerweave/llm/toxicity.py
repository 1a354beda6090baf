"""Toxicity by composed weighted finite-state transducers.

Words become symbols: classes (insult, threatening verb, will, person, group,
object, negation, saying, ...) and the words of which phrases are made. Seven
transducers rewrite or weigh that string: reported speech after a word of
saying, reported speech before one (this one reads from right to left),
phrases, negation, threat, target and score. The six that read from left to
right are composed (lazily: a composed arc is made when it is first taken),
and the composition runs over the sentences that hold a symbol of interest.

An insult is a listed or learned word or a phrase ("piece of trash"). A threat
is a verb with somebody as its object ("kill you", "hurt all of them", "dich
töten", "te matar"), strong where it is meant to happen ("I will kill you") or
ordered ("Kill them all"), weak otherwise; or a phrase ("you deserve to die").
"They beat the market" and "you hunt for your keys" have no such object. What
is scored is the matched clause (what stands between stops, commas and words
like "but"), with its target, negation and reporting, not the word.

The word lists are in English, French, German and Spanish. Insult words beyond
them come from the labels: stems whose words stand in many different contexts
of toxic documents and (almost) never in clean ones are insults.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, ready, rest, shielded

FILL, INSULT, VERB, WILL, PERSON, GROUP, NOT, SAYS, COMMA, STOP, BUT, FOR, SKIP, OWN, KIN, BEFORE = range(16)
#: Symbols that only the transducers write.
R_INSULT, R_VERB, T_INSULT, RT_INSULT, NEGATED, LATE, STRONG, WEAK, R_STRONG, R_WEAK = range(16, 26)

SEED = {
    INSULT: "idiot idiots moron morons scum trash loser losers clown clowns pathetic worthless disgusting stupid dumb imbecile imbeciles vermin filth"
    " filthy cretin cretins degenerate degenerates parasite parasites subhuman freak freaks dimwit halfwit bastard bastards jerk jerks coward cowards"
    " scumbag scumbags lowlife retard retarded bitch whore slut asshole assholes imbécile imbéciles crétin crétins crétine connard connards connasse"
    " salope salopes salaud abruti abrutie abrutis débile débiles ordure ordures minable minables pouffiasse trottel arschloch arschlöcher dummkopf"
    " schwachkopf abschaum versager schlampe hurensohn vollidiot vollidioten idioten blödmann missgeburt untermensch drecksau idiota idiotas imbécil"
    " imbéciles estúpido estúpida estúpidos escoria cabrón cabrones gilipollas inútil inútiles subnormal pendejo pendejos maricón asqueroso asquerosa",
    VERB: "kill murder hurt destroy stab shoot strangle beat hunt burn rape torture slaughter exterminate behead hang choke tuer buter frapper étrangler"
    " poignarder massacrer égorger exterminer violer töten umbringen erwürgen erstechen erschießen abstechen verprügeln vernichten vergewaltigen"
    " matar golpear apuñalar estrangular destruir violar degollar exterminar",
    WILL: "will gonna shall must should i'll we'll they'll i'm want wanna vais va vas allons allez vont werde wirst wird werden werdet will wollen"
    " voy vas vamos van quiero tuerai mataré",
    PERSON: "you him her yourself he she tu toi il elle du er sie tú usted él ella you're t'es yourselves eres sos",
    GROUP: "they them themselves people everyone everybody ils eux ihr ellos ellas ustedes vosotros",
    NOT: "not never no isn't aren't ain't don't won't without neither nor nobody hardly cannot can't isnt arent dont wont doesn't wouldn't pas jamais"
    " aucun aucune sans nicht kein keine keinen keiner nie niemals ohne nunca jamás ningún ninguna sin",
    SAYS: "said says say saying wrote writes claimed claims claim called calls alleged reported reports quoted quotes told tells asked according dit"
    " disait déclaré affirme affirmé écrit raconte selon sagt sagte behauptet behauptete schrieb meinte laut dijo dice dicen decía según afirma afirmó"
    " escribió",
    BUT: "but however mais cependant aber jedoch pero sino",
    FOR: "for about with against pour für por para con",
    SKIP: "all every each both one of the those these and or every single tous toutes alle jeden todos todas a",
    OWN: "your his their ihre eure dein deine deinen",
    KIN: "family wife husband mother father kids children son daughter sister brother mom face neck head throat famille mère père enfants femme"
    " familie mutter vater kinder familia madre padre hijos",
    BEFORE: "dich dir euch te vous os",
}
PHRASES = {
    INSULT: [
        "piece of trash", "piece of shit", "piece of garbage", "piece of filth", "piece of crap", "waste of space", "waste of oxygen", "waste of skin", "son of a bitch",
        "shut up", "go to hell", "screw you", "fuck you", "go fuck yourself", "fils de pute", "tas de merde", "ferme ta gueule", "va te faire foutre", "sale con", "pauvre con",
        "stück dreck", "stück scheiße", "halt die fresse", "halt die klappe", "leck mich", "fick dich", "hijo de puta", "pedazo de mierda", "vete a la mierda", "vete al infierno",
    ],
    STRONG: [
        "you will die", "you should die", "you must die", "you deserve to die", "you are going to die", "you're going to die", "i hope you die", "go die", "you are dead", "you're dead",
        "watch your back", "kill yourself", "tu vas mourir", "tu vas crever", "je te tuerai", "du wirst sterben", "du bist tot", "bring dich um", "bringe dich um", "vas a morir",
        "te mataré", "te voy a matar", "voy a matarte", "os mataré", "vais vous tuer",
    ],
}
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;\n]|[,:\"“”«»()]")
PUNCT = {**dict.fromkeys(".!?;\n", STOP), **dict.fromkeys(",:\"“”«»()", COMMA)}
SCOPE, NEAR, MEANT, REACH = 3, 4, 4, 3
WEIGHT = {INSULT: 1.0, R_INSULT: 0.25, T_INSULT: 2.0, RT_INSULT: 0.5, LATE: 1.0, STRONG: 3.0, WEAK: 1.0, R_STRONG: 0.5, R_WEAK: 0.0}

#: Words of phrases are symbols of their own from here on; by symbol, what class the word is otherwise.
FIRST = 32
_OF_CLASS = {w: c for c, words in SEED.items() for w in words.split()}
_PHRASE_WORDS = sorted({w for many in PHRASES.values() for p in many for w in p.split()})
SYMBOL = {w: FIRST + i for i, w in enumerate(_PHRASE_WORDS)}
CLASS = {FIRST + i: _OF_CLASS.get(w, FILL) for i, w in enumerate(_PHRASE_WORDS)}


class Transducer:
    """Sequential: ``step(state, symbol)`` gives the next state and what is written for the symbol."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def _ends(c: int) -> bool:
    return c in (STOP, COMMA, BUT)


def reported() -> Transducer:
    """After a word of saying, up to the sentence's end, what is said is somebody else's: state 1 writes it as reported."""

    def step(s, c):
        if c == STOP:
            return 0, (c, 0)
        return (1 if c == SAYS else s), (c, s)

    return Transducer(0, step)


def reported_before() -> Transducer:
    """Read from the sentence's end: '..., he said.' makes all that stands before the comma reported. States: words read (0..3), 4 saying was read, 5 reported, 6 not."""

    def step(s, c):
        if c == STOP:
            return 0, 0
        if s == 5:
            return 5, 1
        if s == 6:
            return 6, 0
        if s == 4:
            return (5 if c == COMMA else 4 if c in (PERSON, GROUP, FILL) else 6), 0
        return (4 if c == SAYS else s + 1 if s < 3 and c != COMMA else s if c == COMMA and s == 0 else 6), 0

    return Transducer(0, step)


def phrases() -> Transducer:
    """A trie of the phrases with failure links: the last word of one is written as what the phrase is, other words as their class."""
    next_, out, fail = [{}], [None], [0]
    for kind, many in PHRASES.items():
        for p in many:
            at = 0
            for w in p.split():
                if SYMBOL[w] not in next_[at]:
                    next_[at][SYMBOL[w]] = len(next_)
                    next_.append({}), out.append(None), fail.append(0)
                at = next_[at][SYMBOL[w]]
            out[at] = kind
    todo = list(next_[0].values())
    for at in todo:
        for c, to in next_[at].items():
            f = fail[at]
            while f and c not in next_[f]:
                f = fail[f]
            fail[to] = next_[f].get(c, 0)
            out[to] = out[to] if out[to] is not None else out[fail[to]]
            todo.append(to)

    def step(s, x):
        c, said = x
        while s and c not in next_[s]:
            s = fail[s]
        s = next_[s].get(c, 0)
        if out[s] is not None:
            return 0, (out[s], said)
        return s, (CLASS.get(c, c), said)

    return Transducer(0, step)


def negation() -> Transducer:
    """A negation holds for the next SCOPE words of its clause."""

    def step(s, x):
        c, said = x
        if _ends(c):
            return 0, x
        if c == NOT:
            return SCOPE, x
        return max(s - 1, 0), ((NEGATED, said) if s and c in (INSULT, VERB, STRONG) else x)

    return Transducer(0, step)


def threat() -> Transducer:
    """Verbs become threats at their object.

    State: (words left in which a will or wish counts, a pronoun before the
    verb counts, the verb waits for an object; whether the verb is strong;
    whether a clause begins; whether a possessive stands before).
    """
    start = (0, 0, 0, False, True, False)

    def step(s, x):
        will, pre, wait, strong, first, own = s
        c, said = x
        if _ends(c):
            return start, x
        hit = None
        if c == VERB:
            strong = will > 0 or first
            if pre and will:
                hit, wait = STRONG, 0
            else:
                wait = REACH
        elif wait and (c in (PERSON, GROUP, BEFORE) or c == KIN and own):
            hit, wait = (STRONG if strong else WEAK), 0
        elif wait and c not in (SKIP, OWN):
            wait = 0
        will, pre = (MEANT if c == WILL else max(will - 1, 0)), (REACH if c == BEFORE else max(pre - 1, 0))
        state = (will, pre, max(wait - (c == SKIP), 0), strong and wait > 0, False, c == OWN)
        return state, ((hit, said) if hit is not None else x)

    return Transducer(start, step)


def target() -> Transducer:
    """An insult with a person or group at most NEAR words away is targeted.

    States 0..NEAR: words left in which a target that came before counts;
    NEAR+1..2*NEAR: words left in which a target completes what came before.
    What is reported is written in its reported form.
    """
    as_said = {INSULT: R_INSULT, STRONG: R_STRONG, WEAK: R_WEAK, T_INSULT: RT_INSULT}

    def step(s, x):
        c, said = x
        own = (lambda y: as_said.get(y, y)) if said else (lambda y: y)
        if c == STOP:
            return 0, c
        if c in (PERSON, GROUP, BEFORE, OWN):
            return NEAR, LATE if s > NEAR else c
        if c == INSULT:
            return (s, own(T_INSULT)) if 0 < s <= NEAR else (2 * NEAR, own(c))
        if c in (STRONG, WEAK):
            return NEAR, own(c)
        if s > NEAR:
            return (s - 1 if s > NEAR + 1 else 0), c
        return max(s - 1, 0), c

    return Transducer(0, step)


def scorer() -> Transducer:
    """The weight of each symbol; a clause's end is written as None."""
    return Transducer(0, lambda s, c: (s, None if _ends(c) else WEIGHT.get(c, 0.0)))


class Composed(dict):
    """first o second o ...: (state, symbol) -> (state, what the last one writes); arcs are made when first taken. There are finitely many."""

    def __init__(self, *machines: Transducer):
        super().__init__()
        self.machines = machines
        self.start = tuple(m.start for m in machines)

    def __missing__(self, arc):
        states, c = arc
        to = []
        for m, s in zip(self.machines, states):
            s, c = m.step(s, c)
            to.append(s)
        made = self[arc] = tuple(to), c
        return made


def grammar() -> tuple[Composed, Composed]:
    """The machine that reads from right to left, and the composition of the others."""
    return Composed(reported_before()), Composed(reported_after_marks(), phrases(), negation(), threat(), target(), scorer())


def reported_after_marks() -> Transducer:
    """``reported`` over symbols that may already be marked as reported from the right: (symbol, mark)."""
    inner = reported()

    def step(s, x):
        c, mark = x
        s, (c, said) = inner.step(s, CLASS.get(c, c) if CLASS.get(c) in (SAYS, STOP) else c)
        return s, (c, said or mark)

    return Transducer(0, step)


class Lexicon(dict):
    """word -> symbol: the words of phrases and of the lists, then stems (a stem that ends in $ is a whole word)."""

    def __init__(self, stems: list[str]):
        super().__init__(_OF_CLASS | SYMBOL | PUNCT)
        whole = [x[:-1] for x in stems if x.endswith("$")]
        self.update({w: INSULT for w in whole if w not in self})
        self.stems = tuple(x for x in stems if not x.endswith("$"))
        self.fixed = dict(self)

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        made = self[word] = self.fixed.get(word, INSULT if self.stems and word.startswith(self.stems) else FILL)
        return made


#: Symbols without which a sentence cannot score.
_STOPS = bytes([STOP])
_LAST = {SYMBOL[p.split()[-1]] for many in PHRASES.values() for p in many}
_CALLING = {INSULT, VERB} | _LAST | {x for x, c in CLASS.items() if c in (INSULT, VERB)}
_CALLS = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in sorted(_CALLING)) + b"]")


def clause_scores(text: str, lexicon: Lexicon, machines: tuple[Composed, Composed]) -> list[float]:
    """Weight of every clause that matches, in order."""
    codes = bytes(map(lexicon.__getitem__, TOKEN.findall(text.lower())))
    if not _CALLS.search(codes):
        return []
    back, ahead = machines
    found = []
    for part in codes.split(_STOPS):
        if not _CALLS.search(part):
            continue
        marks, state = [], back.start
        for c in reversed(part):
            state, m = back[state, CLASS.get(c, c)]
            marks.append(m)
        state, total = ahead.start, 0.0
        for c, m in zip(part, reversed(marks)):
            state, w = ahead[state, (c, m)]
            if w is None:
                if total:
                    found.append(total)
                total = 0.0
            else:
                total += w
        if total:
            found.append(total)
    return found


def learn_stems(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, support: int = 5, clean_share: float = 0.02, shortest: int = 4, longest: int = 14
) -> list[str]:
    """Stems of insult words, from at most ``max_labelled`` labelled documents (by hash of the id).

    Support counts different pairs of neighbours (w-1, w+1), so copies of one
    document count once. A stem needs ``support`` of them in toxic documents
    and at most ``clean_share`` as many uses in clean ones; it is then drawn
    out as long as it loses under 5 % of its support. Stems have up to
    ``longest`` letters; a longer word counts as a whole. The bound is the
    documented one on labelled rows.
    """
    labels = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    words = F.filter(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(sample), "doc_id")
        .select("toxic", words.alias("w"))
        .filter("size(w) > 0")
        .select("toxic", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), "w").alias("p"), F.col("w"), F.expr("slice(w, 2, size(w))").alias("n"))).alias("x"))
        .filter("x.w is not null")
    )
    by_word = rows.groupBy(F.col("x.w").alias("w")).agg(
        F.count_distinct(F.when(F.col("toxic") > 0, F.xxhash64("x.p", "x.n"))).alias("bad"), F.count(F.when(F.col("toxic") <= 0, 1)).alias("good")
    )
    starts = f"transform(sequence({shortest}, greatest({shortest}, least(length(w) + 1, {longest}))), n -> left(concat(w, '$'), n))"
    cut = F.explode(F.expr(f"if(length(w) >= {longest}, concat({starts}, array(concat(w, '$'))), {starts})"))
    by_stem = by_word.filter(f"length(w) >= {shortest - 1}").select(cut.alias("stem"), "bad", "good").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    kept = {r.stem: r.bad for r in by_stem.filter(f"bad >= {support} and good <= {clean_share} * bad").collect()}
    found = []
    for stem in sorted(kept, key=lambda x: (len(x), x)):
        if stem[:-1] in kept:
            continue
        while longer := [x for x in kept if len(x) == len(stem) + 1 and x.startswith(stem) and kept[x] >= 0.95 * kept[stem]]:
            stem = longer[0]
        found.append(stem)
    return sorted(set(found))


def score_udf(stems: list[str]):
    """Column function text -> struct(clauses, top, score)."""

    @F.pandas_udf("clauses int, top double, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexicon, table = alone(Lexicon(stems)), grammar()
        for text in batches:
            got = [clause_scores(t, lexicon, table) if t else [] for t in text]
            yield pd.DataFrame({"clauses": [len(x) for x in got], "top": [max(x, default=0.0) for x in got], "score": [float(sum(x)) for x in got]})
        rest()

    return score


def toxicity(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 2.0, **learn) -> DataFrame:
    """(doc_id, clauses, top, score, toxic), one row for each row of ``docs``.

    clauses: matched clauses; top: the largest weight of one; score: their
    sum; toxic: score >= threshold, that is one targeted insult, one strong
    threat, or two insults or weak threats. A null or empty text scores 0; a
    null doc_id stays null; repeated rows are scored each; texts count whole,
    however long; other columns are not looked at; an empty table gives an
    empty one; without labels (or with an empty table of them) only the lists
    are used.
    """
    ready(docs.sparkSession)
    stems = learn_stems(docs, labels, **learn) if labels is not None else []
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_udf(stems)(F.col("text").cast("string")).alias("s"))
    return got.select("doc_id", "s.clauses", "s.top", "s.score", (F.col("s.score") >= threshold).alias("toxic"))


@shielded
def reject_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame | None, threshold: float = 2.0, **learn) -> DataFrame:
    """``docs`` without the rows that ``toxicity`` rejects; all columns and all other rows stay, null texts among them."""
    ready(spark)
    stems = learn_stems(docs, labels, **learn) if labels is not None else []
    return docs.withColumn("__tox", score_udf(stems)(F.col("text").cast("string"))["score"]).filter(F.col("__tox") < threshold).drop("__tox")
