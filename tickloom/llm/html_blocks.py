"""HTML extraction by two-pass block rules.

First pass: the page is cut into blocks at block-level tags, and each block is judged by its
length, its link density (characters inside links) and its stop-word density. Second pass:
ambiguous blocks (``short``, ``near``) inherit the label of their nearest decided neighbours;
where those differ the block counts as boilerplate, unless it is ``near`` and one of them is good.
Headings that are followed closely by a good block are kept.

The stop words are those of the page's language: the declared one when enough of its words are on the page, else the
one with most. A page that no list fits (another language, or a script without spaces) is judged by length and
link density alone. Ideographs and the like count as three characters, as they say as much.

Defined results: a null page gives null text and no blocks; an empty page, or one without text,
gives an empty text; malformed markup is read as far as tags go and the rest is text: a tag ends at the next ``<``
outside quotes, so that reading takes linear time; texts may be
of any length; repeated rows give equal results; other columns pass through (``extracted`` is
replaced).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common function words, by language.
STOP_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset("a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its more my no not of on one or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you your".split()),
    "fr": frozenset("a au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me même mes moi mon ne nos notre nous on ou où par pas plus pour que qui sa se ses si son sont sur ta te tu un une vos votre vous y à été".split()),
    "de": frozenset("aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann mit nach nicht noch nur oder ohne sein sich sie sind so um und uns vom von vor war was wenn werden wie wir wird zu zum zur über".split()),
    "es": frozenset("a al algo como con cuando de del desde donde el ella ellos en entre era es esta este esto fue ha hay la las le les lo los mas me mi muy más ni no nos o para pero por que quien se ser si sin sobre son su sus también te tiene un una uno y ya yo él".split()),
    "it": frozenset("a ad agli ai al alla alle anche che chi ci come con cui da dai dal dalla dei del della delle di dove e ed era gli ha hanno ho i il in io l la le lei lo loro lui ma mi mio ne nei nel nella noi non o per perché più quale quando quella quello questa questo se si sono sua suo sul sulla tra tu un una uno vi voi è".split()),
    "pt": frozenset("a ao aos as com como da das de dela dele do dos e ela elas ele eles em entre era essa esse esta este eu foi há isso isto já lhe mais mas me mesmo meu minha muito na nas nem no nos nossa nosso não o os ou para pela pelas pelo pelos por qual quando que quem se sem ser seu seus sua suas são só também te tem um uma você à é".split()),
    "nl": frozenset("aan al als bij daar dan dat de der deze die dit doch door dus een en er ge geen had heb hebben heeft hem het hier hij hoe hun ik in is ja je kan maar me meer men met mij mijn na naar niet nog nu of om omdat onder ons ook op over te tegen toch toen tot uit van veel voor want waren was wat we werd wie wij wil wordt zal ze zei zich zij zijn zo zonder zou".split()),
    "sv": frozenset("alla att av blev bli de dem den denna deras dess det detta dig din du där då efter ej eller en er ett från för ha hade han hans har henne hon honom hur här i ingen inom inte jag ju kan kunde man med mellan men mig min mot mycket ni nu när någon något några och om oss på samma sedan sig sin sina ska skulle som så till under upp ut utan vad var vara varje vi vid vilka vår är över".split()),
    "da": frozenset("ad af alle alt at blev blive bliver da de dem den denne der deres det dette dig din disse dog du efter eller en end er et for fra ham han hans har havde have hende her hos hun hvad hvis hvor i ikke ind jeg jo kan kunne man mange med meget men mig min mod ned nogle nu når og også om op os over på selv sig sin skal skulle som så til ud under var vi vil ville vor være".split()),
    "no": frozenset("at av bare ble blir da de deg dem den denne der deres det dette din disse du eller en enn er et etter for fra før ha hadde han hans har henne her hun hva hvem hver hvor i ikke inn jeg kan kunne man mange med meg men mer min mot mye ned noe noen nå når og også om opp oss over på seg selv sin skal skulle som så til under ut uten var ved vi vil ville vår være".split()),
    "pl": frozenset("a aby ale bardzo bez bo by być był była było co czy dla do gdy gdzie go i ich ile im inne ja jak jako je jego jej jest jeszcze jeśli już kiedy kto które który którzy ma mi mnie może na nad nas nie nim niż no o od on ona one oni oraz po pod przed przez przy są się ta tak także tam te tego tej ten to tu tylko tym w we więc wszystko z za ze że".split()),
    "cs": frozenset("a aby ale ani asi až bez bude by byl byla bylo být co což do i ja jak jako je jeho jej její jejich jen ještě jsem jsou k kde kdo když která které který má mezi může na nad nebo není než o od on pak po pod podle pro proto protože před při s se si své tak také tam ten tento to toho tom tu u už v ve však za ze že".split()),
    "ro": frozenset("a ai al ale am ar are as au ca care ce cel cea cu da dar de deci din despre după ea ei el ele era este eu face fi fost iar ii il in în la le lor lui mai mult ne nici nu o or ori pe pentru prin sa să sau se si și sunt un una unei unor unui va vor".split()),
    "hu": frozenset("a abban ahol aki akik alatt amely ami amit az azok azt be csak de e egy el ennek ez ezek ezt fel ha hanem hogy is itt ki kell le lehet lesz lett mag meg mely mert mi mint mit most már még ne nem nincs ott pedig s sem több van vannak vagy volt voltak át és így úgy új ő ők".split()),
    "fi": frozenset("ei eivät en että he hän ja jo joita joka jonka jos jotka kanssa kuin kun kuten me minä mitä mukaan mutta myös ne niiden niin nyt näin ole olen oli olisi olla on ovat se sekä sen siitä sillä sitä tai te tämä tämän vain voi yli".split()),
    "tr": frozenset("ama ancak bana bazı ben bile bir biz bu çok çünkü da daha de değil diye en gibi hem hep her hiç için ile ise kadar ki kim mi mu ne neden o olan olarak oldu on onlar onu sen siz şey şu tüm ve veya ya yani".split()),
    "ru": frozenset("а без более бы был была были было быть в вам вас весь во вот все всего вы где да для до его ее если есть еще же за здесь и из или им их к как когда кто ли мне может мы на над надо нас не него нее нет ни них но ну о об он она они оно от по под при с со так также там те тем то того только том ты у уже хотя чего чем что чтобы эта эти это этого этот я".split()),
    "uk": frozenset("а або але без би був була були було бути в вам вас ви від він вона вони все де для до ж за з із і їх й його її як яка який які коли ми може на над не ні про по під при та так також там те тим то тому той тільки у цей це ці через чи що щоб я є".split()),
    "el": frozenset("αλλά αν από αυτά αυτή αυτό αυτός για δεν εγώ είναι εκεί ένα ένας έχει ή η ήταν θα και κατά με μετά μέσα μη μια μου να ο οι όπως όταν ότι παρά πριν προς πως σας σε στα στη στην στις στο στον στους τα την της τι τις το τον του τους των ως".split()),
    "ar": frozenset("إلى أن أو إذا التي الذي الذين أنا أنت أي إن بعد بين به بها ثم حتى ذلك على عن عند غير في قد كان كانت كل كما لا لكن لم لما له لها ليس ما مع من منذ نحن هذا هذه هل هم هنا هناك هو هي و يا يكون".split()),
    "fa": frozenset("آن از است اگر این با باید بر برای بود به تا چه خود در را شد شده شود کرد که ما من می نیز هر هم همه و ولی یا یک".split()),
    "hi": frozenset("अपने और इस इसके एक एवं कर करने का कि किया की के को कोई गया जा जो तक तो था थी थे दिया दो नहीं ने पर भी में यह या ये रहा लिए वह साथ से हुआ है हैं हो".split()),
    "id": frozenset("ada adalah akan anda atas atau bagi bahwa banyak belum bisa dalam dan dapat dari dengan di dia harus hanya ia ini itu jika juga kami karena ke kepada kita lebih mereka namun oleh pada para saat saya sebagai sebuah secara seperti serta sudah tersebut tidak untuk yang".split()),
    "vi": frozenset("bị các cho có còn của cùng cũng do đã đang đây để đến đó được hay hơn khi không là lại lên mà mỗi một này nên nếu người nhiều như những nhưng ra rất sau sẽ tại theo thì trên trong từ và vào vì với".split()),
}
#: Languages that say with endings what others say with function words; half the densities hold for them.
SPARSE = frozenset({"fi", "hu", "tr"})
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center col colgroup dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol optgroup option p pre section table tbody td textarea tfoot th thead title tr ul".split())
BOILERPLATE = frozenset("nav footer aside form head".split())
SKIPPED = "script|style|noscript|template|svg|iframe|object"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({SKIPPED})\b[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^<>]*>|[^<]+|<", re.S | re.I)
LANG = re.compile(r"\blang\s*=\s*[\"']?([a-zA-Z]{2})")
#: What is around words: ASCII other than letters, and some typographic marks.
AROUND = {i: " " for i in (*range(65), *range(91, 97), *range(123, 128), *map(ord, "«»“”‘’„…–—¡¿·©"))}

LENGTH_LOW = 70
LENGTH_HIGH = 140
STOP_LOW = 0.08
STOP_HIGH = 0.15
MAX_LINKS = 0.2
HEADING_DISTANCE = 200
RESULT = "text string, n_blocks int, n_kept int"
_WIDE = re.compile("[\u2e80-\U0010ffff]")


def size(text: str) -> int:
    if text.isascii():
        return len(text)
    return len(text) + 2 * len(_WIDE.findall(text)) if _WIDE.search(text) else len(text)


def blocks(page: str) -> tuple[list[tuple[str, int, bool, bool]], str | None]:
    """((text, characters in links, heading, inside boilerplate tags) of each block, declared language)."""
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked = depth = outside = 0
    heading, lang = False, None

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, linked, heading, outside > 0))
        parts.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        tag = m.group(3)
        if tag is None:
            text = m.group()
            if m.group(1) is None and (text[0] != "<" or text == "<"):
                if "&" in text:
                    text = html.unescape(text)
                parts.append(text)
                if depth:
                    linked += size(" ".join(text.split()))
            continue
        tag, closing = tag.lower(), bool(m.group(2))
        if tag == "html" and not closing and (found := LANG.search(m.group(4))):
            lang = found.group(1).lower()
        if tag == "a":
            depth = 0 if closing else 1
        elif tag in BLOCK_TAGS:
            close()
            if tag in BOILERPLATE:
                outside = max(0, outside - 1) if closing else outside + 1
            if tag[0] == "h" and tag[1:].isdigit():
                heading = not closing
    close()
    return out, lang


def tokens(text: str) -> list[str]:
    return text.lower().translate(AROUND).split()


def stop_density(found: Sequence[str], words: frozenset[str]) -> float:
    return sum(map(words.__contains__, found)) / len(found) if found else 0.0


def language(found: Sequence[str], declared: str | None) -> str | None:
    """The language whose stop words judge a page with these words; None when none fits."""
    known = declared in STOP_WORDS
    if known and stop_density(found, STOP_WORDS[declared]) >= STOP_LOW:
        return declared
    density, best = max((stop_density(found, w), lang) for lang, w in STOP_WORDS.items())
    if density >= STOP_HIGH:
        return best
    if known and sum(any("a" <= c <= "z" for c in w) for w in found) * 2 >= len(found) and "a" <= min(STOP_WORDS[declared])[0] <= "z":
        return declared  # it has the language's letters, but hardly a sentence
    return best if density >= STOP_LOW else None


def first_pass(block: tuple[str, int, bool, bool], lang: str | None, words: Sequence[str] | None = None) -> str:
    """good, bad, short or near; ``words`` are the block's tokens where they are known."""
    text, linked, _, outside = block
    length = size(text)
    if outside or linked > MAX_LINKS * length or "©" in text:
        return "bad"
    if length < LENGTH_LOW:
        return "bad" if linked else "short"
    density = STOP_HIGH if lang is None else stop_density(tokens(text) if words is None else words, STOP_WORDS[lang]) * (2 if lang in SPARSE else 1)
    if density >= STOP_HIGH:
        return "good" if length > LENGTH_HIGH else "near"
    return "near" if density >= STOP_LOW else "bad"


def second_pass(labels: Sequence[str], found: Sequence[tuple[str, int, bool, bool]]) -> list[bool]:
    """Which blocks are kept."""
    n = len(labels)
    before, after = ["bad"] * n, ["bad"] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = "bad"  # the page's edges count as boilerplate
        for i in order:
            side[i] = last
            if labels[i] in ("good", "bad"):
                last = labels[i]
    kept = []
    for i, label in enumerate(labels):
        good = (before[i] == "good") + (after[i] == "good")
        kept.append(label == "good" or label == "short" and good == 2 or label == "near" and good >= 1)
    gap = HEADING_DISTANCE + 1
    for i in range(n - 1, -1, -1):
        if kept[i]:
            gap = 0
        else:
            if found[i][2] and labels[i] == "short" and gap <= HEADING_DISTANCE:
                kept[i] = True
            gap += size(found[i][0])
    return kept


def extract(page: str | None) -> tuple[str | None, int, int]:
    if page is None:
        return None, 0, 0
    found, declared = blocks(page)
    words = [() if b[3] else tokens(b[0]) for b in found]
    lang = language([w for ws in words for w in ws], declared)
    kept = second_pass([first_pass(b, lang, w) for b, w in zip(found, words)], found)
    texts = [b[0] for b, k in zip(found, kept) if k]
    return "\n".join(texts), len(found), len(texts)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with a struct ``extracted`` (see ``RESULT``); only the markup goes to Python."""

    @F.arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        rows: Iterator = [extract(p.as_py()) for p in column]
        cols = list(zip(*rows)) if rows else [()] * 3
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32()))], names=["text", "n_blocks", "n_kept"])

    return pages.withColumn("extracted", run(F.col(html_col).cast("string")))
