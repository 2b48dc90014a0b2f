"""Broken prompt-response pairs: empty, truncated, refused, copied or in another language.

Answers are sorted by text over the whole table and each is compared with its neighbour: one that another continues is a
shortened version. They are sorted as whole texts and, as answers differ in names and numbers, by their shapes: a JSON answer without
its values, each sentence of prose with a mark for what the message says. An answer without a proper end whose last piece
a neighbour goes on is truncated. Lengths at which many different answers of a model stop are length limits, and prose of
such a length is truncated, too. Then rules for refusals, copies and language follow, the first defect that applies in
the order above wins.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talliflow.session import shared_path, spread

#: A length is a limit of a model if this share of the answers that are as long or longer stop there, and this many times as many as at the
#: lengths up to ``SPIKE_WINDOW`` away on average (one is added to the average, so single long answers are none).
SPIKE_SHARE, SPIKE_RATIO, SPIKE_WINDOW = 0.5, 20, 10

#: Answers that stand for none.
PLACEHOLDERS = set(
    "na none null nil nan vacio vazio empty undefined ninguno ninguna nenhum nothing sinrespuesta sinresposta noresponse noanswer "
    "semresposta sindatos sd nd tbd todo placeholder respuestavacia nohayrespuesta".split()
)
#: Words before a repeated message.
LEADS = re.compile(r"\A\W*(?:mensaje|entrada|usuario|input|message|user|mensagem|usuário|texto|text|prompt|consulta|pregunta)\s*:\s*", re.I)

#: Phrases of refusals in Spanish, English and Portuguese, without accents.
REFUSALS = re.compile(
    r"""
    \bno\ (?:puedo|podemos|estoy\ autorizad[oa]|se\ puede|podria|me\ es\ posible|es\ posible|estoy\ en\ condiciones|tengo\ permitido|tengo\ permiso|tengo\ autorizacion|voy\ a|corresponde|debo|quiero|opino|cumple)\b
      (?!\ (?:creer|leer))
    |\bno\ (?:lo|la|los|las|te)\ (?:puedo|voy\ a)\b
    |\b(?:prefiero|mejor)\ no\b
    |\b(?:fuera\ de\ mis\ (?:funciones|posibilidades|limites)|mis\ reglas|me\ impiden|bloqueado\ para|tendria\ que\ rechazar|debo\ rechazar|tengo\ que\ rechazar|me\ niego|rechaz(?:o|a|ada|ado)\b|se\ rechaza|no\ sera\ procesad|aca\ no\ puedo|politicas\ de\ uso|normas\ del\ servicio|me\ abstengo|no\ esta\ permitido|imposible\ ayudar)
    |\b(?:i|we)\ (?:can(?:no|')?t|can\ not|won'?t|will\ not|would\ rather\ not|am\ not\ able|am\ unable|'?m\ (?:not\ able|unable|afraid)|do\ not\ feel|must\ decline|have\ to\ (?:turn|decline|refuse)|prefer\ not|refuse|decline|am\ not\ (?:allowed|permitted|authori[sz]ed))
    |\bi'd\ (?:rather|prefer)\ (?:not|to\ not)
    |\b(?:unable\ to|not\ something\ i\ can|not\ allowed|not\ permitted|against\ the\ rules|goes\ against|keep\ me\ from|turn\ this\ one\ down|outside\ (?:of\ )?my|beyond\ my|would\ rather\ not|cannot\ (?:help|process|assist)|request\ (?:is|was|has\ been)\ (?:declined|rejected|refused|blocked)|is\ blocked\ for\ me|will\ not\ be\ processed)
    |\b(?:nao\ (?:posso|podemos|estou\ autorizad[oa]|tenho\ autorizacao|tenho\ como|consigo|tenho\ permissao|vou|me\ e\ possivel|e\ possivel|estou\ em\ condicoes|devo|cumpre|sera\ processad|opino)|prefiro\ nao|melhor\ nao|fora\ das\ minhas|fora\ do\ meu|minhas\ regras|me\ impedem|teria\ que\ recusar|tenho\ que\ recusar|(?:preciso|precisar|devo|vou)\ recusar|recuso|recusad|e\ rejeitad|foi\ rejeitad|rejeita|bloqueado\ para\ mim|politicas\ de\ uso|regras\ do\ servico)
    """,
    re.X,
)
#: What an answer reads like that did the task.
DONE = re.compile(r"\b(?:sume|anote|anotado|quedo registrado|i recorded|recorded an?|saved an?|there is now|registrou|anotei|foi salvo)\b")

#: Words of each language; those that stand in two of the lists tell nothing.
_WORDS = {
    "es": "el la los las un una del en con su tu y hace ayer hoy mañana anteayer días gasté pagué puse cobré entraron pagaron anotá buenas "
    "perdón demora siento olvidé esto puedo creerlo hola gracias cuenta fecha monto lugar pasado jueves agosto hizo soy cómo veo "
    "buen día quedó vinculada borrar gasto ingreso para tía cena llevar café tostadas viaje centro carga nafta expensas factura luz "
    "compra verduras yerba arroz sueldo mes honorarios fijos remedios tos consulta control arreglo canilla alimento gato entradas función "
    "abono pantalla cuota préstamo comisión flores obsequio cumpleaños gimnasia turno changa pintura reventa sillas listo anoté anotado "
    "registrado perfecto sumé nada acá estoy lo necesites anotar resumen menú decime qué querés usé así pude leer genial por al "
    "interés ganado cambio divisas reintegro inscripción curso libros apuntes",
    "en": "the at with for from and an is are was i we you it this that which paid spent got received yesterday today tomorrow last thursday ago "
    "days hi hello thanks account here how do see summary amount date place method receipt done recorded saved expense income all set there "
    "now your welcome tell want record need what my of on to in card groceries weekly fruit vegetables dinner take away coffee toast rent "
    "bill light fee month booking court gym flowers aunt gift birthday loan instalment salary wages trip fuel did delete can",
    "pt": "na em e já um uma com não foi você oi obrigado obrigada conta paguei gastei ganhei recebi ontem hoje amanhã anteontem quinta passada "
    "data valor local recibo dinheiro cartão despesa receita pronto anotei registrou certo salvo sua diga qual quer anotar estou aqui precisar "
    "da do das dos mês fixos honorários assinatura telas compra aluguel conserto presente flores tia remédios vinculada ficou como vejo "
    "resumo apagar gasto faz dias atrás nós meu minha pelo pela",
}
MARKERS = {
    a: set(_WORDS[a].split()) - {w for b in _WORDS if b != a for w in _WORDS[b].split()} for a in _WORDS
}
_LANGUAGE = {w: k for k, ws in MARKERS.items() for w in ws}
#: Language of a message in which no word tells one: the data's own.
HOME = "es"

_QUOTES = re.compile("\"[^\"]*\"|«[^»]*»|“[^”]*”|‘[^’]*’|(?<!\\w)'[^']*'(?!\\w)")
_TOKEN = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?…][\"'»”’)\]*_`\s]*\Z")
_OPEN_NUMBER = re.compile(r"(\d[\d.,]*?)[.,]\Z")
_AMOUNT = re.compile(r"(?:(?<![^\W_])|u\$s|usd|eur)\d", re.I)
#: An end of a sentence or of a JSON value.
_ENDS = r"(?U)[.!?…\]}][\"'»”’)\]*_`\s]*\z"
#: A value of a JSON member, also one that breaks off.
_VALUE = re.compile(r'(:\s*)(?:"(?:[^"\\]++|\\.)*+(?:"|\\?\Z)|[^\s,\]}"\[{]++)?', re.S)
#: Words and numbers that are masked, currency signs before and blanks between masks, ends of sentences.
_MASKED = re.compile(r"[^\W_]+(?:[.,]\d+)*")
_SIGN = re.compile(r"(?:[$€]|u\$[sd])\s*(?=§)", re.I)
_MARKS = re.compile(r"§(?:[\s.,$€]*§)+")
_TAIL = re.compile(r"(?:(?<=§)[.,]|(?:\bu)?[$€]|\bu\$[sd])*\s*\Z", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_FENCE = re.compile(r"\A```[\w-]*[ \t]*\r?\n?|\s*```\Z")


def _fold_tables() -> tuple[dict, dict, dict]:
    """For ``str.translate``: invisible characters dropped; also in lower case without accents; also letters, digits and symbols only."""
    hidden, low, bare = {}, {}, {}
    for c in [*range(0x3100), *range(0xFE00, 0xFF00)]:
        ch = chr(c)
        base = "".join(x for x in unicodedata.normalize("NFD", ch.lower()) if not unicodedata.combining(x))
        if unicodedata.category(ch) == "Cf" or 0xFE00 <= c <= 0xFE0F:
            hidden[c] = None
            base = ""
        if base != ch:
            low[c] = base
        kept = "".join(x for x in base if x.isalnum() or unicodedata.category(x)[0] == "S")
        if kept != ch:
            bare[c] = kept
    return hidden, low, bare


_HIDDEN, _LOW, _BARE = _fold_tables()
_ANY_HIDDEN = re.compile("[" + "".join(re.escape(chr(c)) for c in _HIDDEN) + "]")
_DECODER = json.JSONDecoder()


def plain(text: str) -> str:
    """Lower case without accents and invisible characters."""
    return text.translate(_LOW)


def letters(text: str) -> str:
    """Letters, digits and symbols only; texts that differ in dress have the same."""
    return text.translate(_BARE)


def language(text: str) -> str | None:
    """The language whose words the text has most of, None where none or two have."""
    words = _TOKEN.findall(unicodedata.normalize("NFC", _QUOTES.sub(" ", text.lower())))
    score = dict.fromkeys(MARKERS, 0)
    for w in words:
        k = _LANGUAGE.get(w)
        if k is not None:
            score[k] += 1
    (top, best), (second, _) = sorted(((n, k) for k, n in score.items()), reverse=True)[:2]
    return best if top > second else None


def states_transaction(message: str) -> bool:
    """Whether a message names an amount: a number that isn't part of a code such as an account's."""
    return _AMOUNT.search(message) is not None


def unwrap(raw: str) -> str:
    """Without blanks, invisible characters and a code fence around it."""
    if _ANY_HIDDEN.search(raw):
        raw = raw.translate(_HIDDEN)
    raw = raw.strip()
    return _FENCE.sub("", raw).strip() if "```" in raw else raw


def _strings(value: Any) -> Iterator[str]:
    """Text leaves of a JSON value."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, dict):
            stack.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            stack.extend(reversed(x))


def _hollow(value: Any) -> bool:
    """Whether a JSON value has no leaf beyond null and placeholders."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack.extend(x.values())
        elif isinstance(x, list):
            stack.extend(x)
        elif isinstance(x, str):
            if letters(x) and letters(x) not in PLACEHOLDERS:
                return False
        elif x is not None:
            return False
    return True


class Parsed:
    """An answer's form: ``kind`` is empty, list (an empty one), records, text or broken; ``text`` its free text."""

    def __init__(self, raw: str | None) -> None:
        self.kind, self.text = "empty", ""
        body = unwrap(raw) if raw is not None else ""
        if body[:1] not in tuple('[{"'):
            key = letters(body)
            if key and key not in PLACEHOLDERS:
                self.kind, self.text = "text", body
            return
        try:
            value, end = _DECODER.raw_decode(body)
        except (ValueError, RecursionError) as e:
            key = letters(body)
            at_end = getattr(e, "pos", 0) >= len(body) or "Unterminated" in str(e) or not _closed(body)
            if body[0] in "[{" and at_end:
                self.kind, self.text = "broken", body
            elif key and key not in PLACEHOLDERS:
                self.kind, self.text = "text", body
            return
        rest = body[end:].strip().strip("`").strip()
        if _hollow(value) and not rest:
            self.kind = "list" if value == [] else "empty"
            return
        items = value if isinstance(value, list) else [value]
        if all(isinstance(x, dict) and x.get("amount") is not None for x in items) and items:
            self.kind = "records"
            self.text = " . ".join([x["description"] for x in items if isinstance(x.get("description"), str)] + ([rest] if rest else []))
        else:
            self.kind, self.text = "leaves", "\n".join([*_strings(value), *([rest] if rest else [])]).strip()


def _closed(body: str) -> bool:
    """Whether all brackets outside of strings are closed."""
    depth, inside, skip = 0, False, False
    for c in body:
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
    return depth <= 0 and not inside


def refuses(text: str) -> bool:
    """Whether a text declines the task and doesn't report it as done."""
    low = plain(text)
    return REFUSALS.search(low) is not None and not DONE.search(low)


def is_copy(message: str, text: str) -> bool:
    """Whether a text is the message, perhaps after a lead word or several times."""
    own = letters(message)
    if not own or own[:3] not in letters(text):
        return False
    for t in (text, LEADS.sub("", text)):
        key = letters(t)
        if key and len(key) % len(own) == 0 and key == own * (len(key) // len(own)):
            return True
    lines = [letters(LEADS.sub("", x)) for x in text.split("\n")]
    return len(own) > 8 and own in lines


def cut_number(message: str, text: str) -> bool:
    """Whether prose stops within a number of the message."""
    cut = _OPEN_NUMBER.search(text)
    return bool(cut) and re.search(re.escape(cut.group(1)) + r"[.,]?\d", message) is not None and not re.search(
        r"(?<![\d.,])" + re.escape(cut.group(1)) + r"(?![.,]?\d)", message
    )


def open_ended(message: str, text: str) -> bool:
    """Whether prose stops without an end of a sentence, or within a number of the message."""
    return not _END.search(text) or cut_number(message, text)


def masked(sentence: str, own: set[str], cut: bool = False) -> str:
    """A sentence with one mark for each stretch of numbers and of words ``own``, those of the message.

    Of a sentence that is ``cut``, a last word that is only begun is left out if a word of the message begins so, as are a sign and the marks
    of a number at the end. So what is masked of a shortened sentence is the beginning of what is masked of the whole one.
    """
    out: list[str] = []
    at = 0
    for m in _MASKED.finditer(sentence):
        word = m.group().lower()
        hit = any(c.isdigit() for c in word) or len(word) > 2 and word in own
        if cut and not hit and m.end() == len(sentence) and any(w.startswith(word) for w in own):
            out.append(sentence[at : m.start()])
            at = m.end()
        elif hit:
            out += [sentence[at : m.start()], "§"]
            at = m.end()
    text = _SIGN.sub("", "".join([*out, sentence[at:]]))
    text = _MARKS.sub("§", text).strip()
    return _TAIL.sub("", text) if cut else text


def words_of(message: str) -> set[str]:
    return {w.lower() for w in _MASKED.findall(message)}


def shape(body: str) -> str:
    """A JSON text without values and blanks (J)."""
    return "J" + "".join(_VALUE.sub(r"\1", body).split())


def pieces(message: str, p: Parsed, body: str) -> list[str]:
    """What may go on another answer: the shape of JSON, of prose the whole text (W) and each sentence that has an end, masked (P)."""
    if p.kind != "text":
        return [shape(body)] if body[:1] in ("[", "{") else []
    own = words_of(message)
    sentences = _SENTENCE.split(body)
    return ["W" + body, *("P" + masked(x, own) for x in (sentences[:-1] if open_ended(message, body) else sentences) if x)]


def piece_to_find(message: str, p: Parsed) -> str | None:
    """What of an answer a neighbour may go on: a shape with open brackets; the last sentence, masked, if it has no end; the whole prose
    if it names no amount that the message states. None if the answer has a proper end."""
    if p.kind == "broken":
        return shape(p.text)
    if p.kind != "text":
        return None
    if open_ended(message, p.text):
        last = _SENTENCE.split(p.text)[-1]
        return "P" + masked(last, words_of(message), cut=True)
    return "W" + p.text if states_transaction(message) and not re.search(r"\d", p.text) else None


def judged(message: str, p: Parsed, continued: bool, at_limit: bool) -> tuple[str | None, str | None]:
    """The first defect that applies, or None, and for a truncated answer what tells it: ``neighbour``, ``limit`` or ``syntax``.

    ``continued`` is whether a neighbour in the order of texts goes on after this answer, ``at_limit``
    whether the answer has a length at which its model's answers pile up. JSON with open brackets breaks off even if no other
    answer has its form (``syntax``).
    """
    if p.kind == "empty" or p.kind == "list" and states_transaction(message):
        return "empty", None
    if p.kind == "list":
        return None, None
    if p.kind == "broken":
        return "truncated", "neighbour" if continued else "limit" if at_limit else "syntax"
    copied = p.kind in ("text", "leaves") and is_copy(message, p.text)
    refused = p.kind in ("text", "leaves") and not copied and refuses(p.text)
    if p.kind == "text" and not copied:
        if continued and (open_ended(message, p.text) or not refused and states_transaction(message) and not re.search(r"\d", p.text)):
            return "truncated", "neighbour"
        if at_limit:
            return "truncated", "limit"
    if refused:
        return "refusal", None
    if copied:
        return "copy", None
    theirs = language(p.text) if p.text else None
    if theirs and theirs != (language(message) or HOME):
        return "language", None
    return None, None


def defect(message: str | None, raw: str | None, continued: bool | None = None, at_limit: bool = False) -> str | None:
    """The first defect of an answer. If it isn't known whether a neighbour goes on, one is taken to do so where the answer has no end."""
    p = Parsed(raw)
    return judged(message or "", p, open_ended(message or "", p.text) if continued is None else continued, at_limit)[0]


# Spark

#: Copies of the small side of the join with answers that may be cut, so that a piece of very many rows is spread.
SALTS = 8


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each text of a sorted partition with the next; the first and last are also returned as the partition's ends."""
    part = TaskContext.get().partitionId()
    last: str | None = None
    first: str | None = None
    for batch in batches:
        texts = batch.column("prose").to_pylist()
        if not texts:
            continue
        first = texts[0] if first is None else first
        pairs = [(a, b) for a, b in zip(([last] if last is not None else []) + texts, texts[0 if last is not None else 1 :]) if b.startswith(a) and a != b]
        last = texts[-1]
        yield _ends([(a, b[len(a) : len(a) + 1], "pair", part) for a, b in pairs])
    if first is not None:
        yield _ends([(first, None, "first", part), (last, None, "last", part)])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["prose", "next_char", "kind", "part"])


def continued_texts(prose: DataFrame) -> DataFrame:
    """``prose, next_char`` of the texts that another text continues.

    The distinct texts are range-partitioned and sorted, so a text's continuation, if any, is its neighbour. Only each
    partition's first and last text meet across partitions.
    """
    spark = prose.sparkSession
    texts = prose.select("prose").distinct()
    path = shared_path(spark, f"answer-neighbours-{uuid.uuid4().hex}")
    texts.repartitionByRange("prose").sortWithinPartitions("prose").mapInArrow(
        _neighbours, "prose string, next_char string, kind string, part int"
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    # two rows per partition, whatever the size of the data: in order, a last text's follower is the next first one
    order = W.orderBy("part", F.when(F.col("kind") == "first", 0).otherwise(1))
    ends = rows.where("kind <> 'pair'").select("*", F.lead("prose").over(order).alias("follower"))
    ends = ends.where((F.col("kind") == "last") & F.col("follower").startswith(F.col("prose")) & (F.col("follower") != F.col("prose")))
    ends = ends.select("prose", F.expr("substring(follower, length(prose) + 1, 1)").alias("next_char"))
    return rows.where("kind = 'pair'").select("prose", "next_char").union(ends)


def length_limits(answers: DataFrame) -> DataFrame:
    """``model, n``: lengths at which a model's different answers (column ``prose``) pile up, beyond which there are few and where most have no end.

    Repeated answers count once, so an answer that is often given makes no limit; nor does a form whose answers all have one length and an end. A window runs over the lengths that a model's answers have.
    """
    counts = answers.groupBy("model", F.length("prose").alias("n")).agg(
        F.approx_count_distinct("prose").alias("k"), F.approx_count_distinct(F.when(~F.col("prose").rlike(_ENDS), F.col("prose"))).alias("open")
    )
    up = W.partitionBy("model").orderBy("n")
    near = F.sum("k").over(up.rangeBetween(-SPIKE_WINDOW, SPIKE_WINDOW)) - F.col("k")
    longer = F.sum("k").over(up.rowsBetween(0, W.unboundedFollowing))
    spike = (F.col("k") >= SPIKE_SHARE * F.col("longer")) & (F.col("k") >= SPIKE_RATIO * (1 + F.col("near") / (2 * SPIKE_WINDOW)))
    spike = spike & (2 * F.col("open") > F.col("k"))
    return counts.withColumn("near", near).withColumn("longer", longer).where(spike).select("model", "n")


def find_defects(predictions: DataFrame, neighbours: bool = True, limits: bool = True) -> DataFrame:
    """``pred_id, defect, evidence`` for every row; ``defect`` is null for a proper answer, ``evidence`` for all but truncated ones.

    A null or blank answer is ``empty``; a null message states nothing and is taken for the data's own language. Repeated rows get the same
    defect each. Nothing is dropped: rows whose answer has a proper end skip the join with the pieces that neighbours go on.
    Prose without an end that no other answer goes on and that has no limit's length is no defect. ``neighbours`` and ``limits`` switch
    these steps off, to see what they find.
    """
    rows = spread(predictions.select(F.col("pred_id").alias("id"), "model", F.col("input").alias("message"), F.col("raw_response").alias("raw")))
    if limits:
        answers = predictions.select("model", F.col("raw_response").alias("prose")).where("prose is not null")
        # a written table has a known size, so Spark broadcasts it where that is small and needn't shuffle the answers
        limit_path = shared_path(predictions.sparkSession, f"answer-limits-{uuid.uuid4().hex}")
        length_limits(answers).withColumn("limited", F.lit(True)).write.parquet(limit_path)
        at = predictions.sparkSession.read.parquet(limit_path)
        rows = rows.withColumn("n", F.length("raw")).join(at, ["model", "n"], "left")
    else:
        rows = rows.withColumn("limited", F.lit(None).cast("boolean"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row's defect, with and without a neighbour that goes on; what such a neighbour has to go on; all pieces (without an id)."""
        for batch in batches:
            found, seen = [], set()
            for m, raw, limited in zip(*(batch.column(k).to_pylist() for k in ("message", "raw", "limited"))):
                m, p = m or "", Parsed(raw)
                if neighbours and raw is not None:
                    seen.update(pieces(m, p, unwrap(raw)))
                key = piece_to_find(m, p) if neighbours else None
                seen.update([key] if key is not None else [])
                without = judged(m, p, False, bool(limited))
                found.append((key, *(judged(m, p, True, bool(limited)) if key is not None else without), *without))
            n = len(found)
            found += [(x, None, None, None, None) for x in seen]
            ids = pa.concat_arrays([batch.column("id").cast(pa.int64()), pa.nulls(len(seen), pa.int64())])
            piece = pa.array([False] * n + [True] * len(seen), pa.bool_())
            cols = list(zip(*found)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([ids, piece, *(pa.array(c, pa.string()) for c in cols)], names)

    names = ["id", "piece", "prose", "if_defect", "if_evidence", "defect", "evidence"]
    path = shared_path(predictions.sparkSession, f"answers-{uuid.uuid4().hex}")
    rows.select("id", "message", "raw", "limited").mapInArrow(look, "id bigint, piece boolean, prose string, if_defect string, if_evidence string, defect string, evidence string").write.parquet(path)
    looked = predictions.sparkSession.read.parquet(path)
    out = [F.col("id").alias("pred_id"), "defect", "evidence"]
    sure = looked.where("not piece and prose is null").select(*out)
    # few pieces are another one's beginning, so this side is small; it is repeated under each salt
    cut = continued_texts(looked.where("piece").select("prose"))
    cut = cut.select("prose", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("cut"))
    may = looked.where("not piece and prose is not null").withColumn("salt", F.pmod(F.xxhash64("id", "if_defect"), F.lit(SALTS)).cast("int"))
    may = may.join(cut, ["prose", "salt"], "left")
    for name in ("defect", "evidence"):
        may = may.withColumn(name, F.when(F.col("cut"), F.col(f"if_{name}")).otherwise(F.col(name)))
    return sure.union(may.select(*out))
