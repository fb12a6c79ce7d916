"""Template residue and error-page text.

The corpus decides, in three ways, and word lists only name what it shows.

Slots. Lines of prose are aligned by their stable parts: the line without the spans that look like a name, a default or
a blank is its frame, and all records of a frame, filled or not, lie under each other. A column whose value changes from
document to document is a slot; a record that still has a name, a default or a blank there was never filled. Spans in
delimiters that prose doesn't use (as in {{ name }}) need one other record with another value, spans that prose does use
(as in [Board Title]) too, marks and bare defaults of no listed style (#NAME#, Your Project Name) two other lines that
fill the same places with plain words.

Pages. Menus, headings and footers aside, a page is residue if all its lines belong to page templates: lines that come
again on other pages, where at least one line names the page as a server's message, a notice about scripts or filler.
Lines of unknown wording belong if, in the whole corpus, they come again and again on just those pages, and on pages that
differ from each other: a copy or a longer version of a document says nothing about its lines. A page of nothing but such
lines is residue too, without any known wording.

Filler. The vocabulary of filler is learned: words that stand, over all documents, mostly in lines of filler. Lines made of
them are filler wherever they stand.

What the corpus holds once only can't be aligned. Such a record counts if its own mark or wording is unmistakable; the
column evidence tells these (alone) from the others (aligned, repeated).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.runtime import drop_scratch, materialize

#: An unknown line belongs to page templates if at least so many different pages have it, and so much of its texts are such pages.
LINE_TIMES, LINE_SHARE = 2, 0.9
#: A word belongs to filler if so many documents have it there, and so much of all that have it; a line, if so much of its words do.
WORD_TIMES, WORD_SHARE, FILLER_SHARE = 3, 0.6, 0.75
#: Words of a line of known wording from which on it is aligned as a whole only.
GAPPED = 100

_FENCE = re.compile(r"^\s*(```|~~~)")
_QUOTE = re.compile(r"^\s*(?:>\s?)+")
_TICKS = re.compile(r"(`+)(?!`).+?(?<!`)\1(?!`)")
_HTML = re.compile(
    r"</?(?:html|head|body|title|h[1-6]|p|div|span|br|hr|a|b|i|em|strong|small|center|ul|ol|li|dl|dt|dd|table|thead|tbody|tr|td|th|"
    r"pre|code|noscript|script|style|img|form|input|button|label|meta|link|section|article|nav|main|header|footer|blockquote)"
    r"(?:\s[^<>]*)?/?>", re.I,
)
#: Tags that end a line.
_BLOCK = re.compile(r"</?(?:title|h[1-6]|p|div|br|hr|center|ul|ol|li|dl|dt|dd|table|tr|td|th|noscript|section|article|nav|main|header|footer|blockquote)(?:\s[^<>]*)?/?>", re.I)
#: Styles of template fields. Those in WEAK are also used by prose.
_FIELD = re.compile(
    r"(?P<mustache>\{\{\{?[#/^>&~]?\s*[A-Za-z_$][\w.$ :|'\"()-]*\}?\}\})"
    r"|(?P<dollar>\$\{[A-Za-z_][\w.:\- ]*\})|(?P<paren>\$\([A-Za-z_][\w.\- ]*\))|(?P<hash>#\{[A-Za-z_@][\w. ]*\})"
    r"|(?P<erb><%[=-]?\s*[A-Za-z_@][\w.@ ()\[\]'\"]*-?%>)|(?P<stmt>\{%-?\s*[A-Za-z_][\w. |]*-?%\})"
    r"|(?P<pct>%%[A-Za-z_][\w ]*%%|%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+%)|(?P<pyfmt>%\([A-Za-z_]\w*\)[sdifr])"
    r"|(?P<dblsq>\[\[[A-Za-z_][\w |:.-]*\]\])|(?P<dblang><<[A-Za-z_][\w .:-]*>>)|(?P<star>\*\|[A-Za-z_][\w:. ]*\|\*)"
    r"|(?P<pipe>\|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\|)|(?P<at>@[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+@)"
    r"|(?P<dunder>(?<![\w])__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+__(?!\w))|(?P<amp>&[A-Za-z]+(?:_[A-Za-z]+)+;)"
    r"|(?P<todo>(?<!\w)(?:TBD|XXX|FIXME)_[A-Z0-9]+(?:_[A-Z0-9]+)*(?!\w))"
    r"|(?P<brace>(?<![\w\\$#{%/)=])\{[A-Za-z_][\w. ]*\}(?![\w}]))"
    r"|(?P<square>(?<![\w\]\\!])\[[^\W\d_][^\[\]\n|`{}=;]*\](?![(\[:\w]))|(?P<angle>(?<![\w<])<[^\W\d_][^<>\n=/|`;{}()@]*>(?!>))"
    r"|(?P<blank>(?<=[:：])[ \t]*_{3,}|(?<=[:：])[ \t]*\.{5,}\s*$)"
)
#: What a line has if any of the styles is in it; cheap to look for.
_HINT = re.compile(r"[{\[<%@|&]|\$[({]|__|(?:TBD|XXX|FIXME)_|\.{5}")
WEAK = frozenset(("square", "angle"))
#: Words by which a bracketed span asks to be replaced.
_ASKS = re.compile(
    r"(?i)\b(?:insert|inserte|insertar|ins[eé]rez|ins[eé]rer|einf(?:ü|ue)gen|eingeben|enter|your|ihre?|ihren|votre|vos|su|tu|put|add|"
    r"replace|fill\s+in|nom\s+d[eu]|nombre\s+de|name\s+(?:here|of)|(?:goes\s+)?here|hier|placeholder|tbd|to\s+be\s+\w+)\b"
)
_TITLE = re.compile(r"(?:[A-ZÀ-Þ][a-zà-ÿ]+(?: [A-ZÀ-Þ][a-zà-ÿ]+)+|[A-ZÀ-Þ]{2,}(?:[ _][A-ZÀ-Þ]{2,})+)$")
#: Spans that may be an unfilled slot if other records of their line have plain words there: marked names, defaults, blanks.
_SLOT = re.compile(
    r"(?<![\w#~^!+@$%&|:])(?P<d>(?!~~)(?P<c>[#~^!+@$%&|:])(?P=c){0,2})(?:[A-Z][A-Z0-9_]+(?:[ -][A-Z0-9_]+){0,3}(?P=d)|(?<=[#~^!+@])[A-Za-z_]\w*(?: [A-Za-z_]\w*){0,3}(?P=d))(?![\w#~^!+@$%&|:])"
    r"|(?<!\w)(?:Your|My|Insert|Enter|Sample|Example|Default)(?: [A-Z]\w*){1,4}(?!\w)|(?<![\w_])_{3,}(?![\w_])|(?<= )\.{5,}(?= |$)"
)
#: What a text has if any of them is in it; cheap to look for.
_SLOT_HINTS = (re.compile(r"[#~^!+@$%&|:][A-Za-z_][\w -]*[#~^!+@$%&|:]"), re.compile(r"(?:Your|My|Insert|Enter|Sample|Example|Default) [A-Z]"))
#: What stands in a filled slot, and how many different lines have to show it.
_VALUE, SLOT_VALUES = r"\S+(?: \S+){0,5}", 2
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:#\s*(?:include|define|if|ifdef|ifndef|endif|pragma)\b|\$ |>>> |echo |sed |export |set\(|return\b|static |const |def |class )|^\s*[\w.]+\s*[-+|&]?=[^=]|->|::\w+\(")

_STATUS = (
    r"(?:bad request|unauthori[sz]ed|payment required|forbidden|(?:page |file )?not found|method not allowed|not acceptable|"
    r"request time-?out|conflict|gone|length required|payload too large|too many requests|internal server error|not implemented|"
    r"bad gateway|service (?:temporarily )?unavailable|gateway time-?out|server error|proxy error)"
).replace(" ", r"\s+")
#: Wordings of messages by servers and sites.
_SERVER = re.compile(
    rf"""(?ix) ^ (?:
      http(?:/\d(?:\.\d)?)?\s*(?:status|error)?\s*:?\s*[45]\d\d\b .{{0,80}}
    | (?:error|fehler|erreur|status|code)?\s*:?\s*[45]\d\d\s*[|:–—-]?\s*{_STATUS} (?:[.!]?|[.:,]\s.*)
    | (?:error|erreur|status|code)\s*:?\s*[45]\d\d[.!]? | fehler\s*[45]\d\d\b .* | status:\s*[45]\d\d
    | {_STATUS}\s*(?:\(?(?:error|erreur)?\s*[45]\d\d\)?)?[.!]? | message:\s*{_STATUS}[.!]? | error:\s*{_STATUS}[.!]?
    | [45]\d\d:\s+(?:the\s+)?server\b .*
    | (?:the\s+)?server\s+(?:could\s+not|cannot|can't|was\s+unable|is\s+(?:down|busy|overloaded|unavailable)|encountered|made\s+a\s+mistake)\b .*
    | the\s+requested\s+(?:url|page|resource|file|document|address)\b .*
    | (?:sorry|oops|whoops|uh-oh)\b[,!.:]?\s .* (?:page|content|document|file|link|here|wrong|available|found|exist) .*
    | .{{0,40}}\b(?:content|page|document|thread|article|file|topic)\b.{{0,40}}\b(?:no\s+longer\s+(?:available|exists?)|has\s+been\s+(?:removed|deleted|moved)|does\s+(?:not|n't)\s+exist)\b .{{0,60}}
    | (?:la\s+)?p[aá]gina\s+no\s+(?:encontrada|existe|disponible) .* | lo\s+sentimos\b .*
    | (?:die\s+)?(?:angeforderte\s+)?seite\s+(?:wurde\s+)?(?:nicht\s+gefunden|existiert\s+nicht)[.!]? | die\s+angeforderte\s+seite\b .*
    | (?:la\s+)?page\s+(?:introuvable|non\s+trouv[eé]e|n'existe\s+plus) .* | (?:le|la)\s+(?:document|page)\b.{{0,60}}\bn'existe\s+(?:plus|pas)\b .*
    | too\s+many\s+requests[.!] .* | you\s+have\s+(?:hit|reached|exceeded)\s+the\s+(?:rate\s+)?limit\b .*
    | (?:access|permission)\s+denied[.!]? .{{0,120}} | you\s+(?:do\s+not|don't)\s+have\s+permission\b .* | zugriff\s+verweigert .{{0,80}} | acc[eè]s\s+refus[eé] .{{0,80}} | acceso\s+denegado .{{0,80}}
    | please\s+check\s+the\s+(?:address|url)\b .* | try\s+again\s+later\b .* | please\s+try\s+again\b .*
    | (?:the|this)\s+(?:site|website|page|wiki|host|server|service)\s+(?:did\s+not\s+answer|can(?:'t|not)\s+be\s+reached|is\s+(?:down|temporarily)|could\s+not\s+be)\b .*
    | (?:the\s+)?database\s+(?:behind|error|connection|could)\b .* | error\s+establishing\s+a\s+database\s+connection .*
    | your\s+session\s+has\s+(?:expired|timed\s+out)\b .* | (?:ihre|die)\s+sitzung\s+ist\s+abgelaufen .*
    | checking\s+(?:your|the)\s+browser\b .* | (?:please\s+)?(?:verify|confirm)\s+(?:that\s+)?you\s+are\s+(?:a\s+)?(?:human|not\s+a\s+robot)\b .*
    | (?:php\s+)?(?:fatal\s+error|parse\s+error|warning|notice|deprecated)\s*:\s .* \bon\s+line\s+\d+\b .*
    | traceback\s+\(most\s+recent\s+call\s+last\): | an?\s+(?:unexpected\s+|internal\s+)?error\s+(?:has\s+)?occurr?ed\b .*
    | (?:the\s+)?(?:web)?site\s+is\s+(?:currently\s+)?(?:under|down\s+for)\s+maintenance .*
    ) $"""
)
#: Wordings of notices that scripts or cookies must be switched on.
_SCRIPT_WORD, _ON = r"(?:java\s?script|scripts?|scripting|cookies?|skripte?)", r"(?:enabl\w*|activ\w*|aktiv\w*|switch\w*|turn\w*|allow\w*|requir\w*|need\w*|einschalten|zulassen|habilit\w*|permit\w*|autoris\w*)"
_NOTICE = re.compile(
    rf"""(?ix) ^ (?:
      (?:please\s+|you\s+(?:must|need\s+to|have\s+to)\s+)?{_ON}\s+{_SCRIPT_WORD}\b .{{0,120}}
    | (?:bitte\s+)?aktivieren\s+sie\s+{_SCRIPT_WORD}\b .{{0,120}} | (?:veuillez\s+)?activer\s+{_SCRIPT_WORD}\b .{{0,120}}
    | (?:por\s+favor,?\s+)?(?:active|habilite|activa)\s+{_SCRIPT_WORD}\b .{{0,120}}
    | noscript\s*: .* | {_SCRIPT_WORD}\s+(?:is|are|must\s+be|has\s+to\s+be|seems?\s+to\s+be)\s+(?:currently\s+)?(?:disabled|off|turned\s+off|blocked|enabled|on|switched\s+on|required|allowed)\b .{{0,120}}
    | (?:this|the|our)\s+(?:site|page|viewer|app|application|website|content)\b.{{0,40}}\b(?:requires?|needs?|works?\s+(?:only\s+)?with|will\s+not\s+\w+\s+(?:until|without)|won't\s+\w+\s+(?:until|without)|cannot\s+\w+\s+without)\b.{{0,20}}\b{_SCRIPT_WORD}\b[^;]{{0,30}}
    | if\s+nothing\s+happens\b .* | your\s+browser\b.{{0,30}}\b{_SCRIPT_WORD}\b .{{0,60}}
    ) $"""
)
#: Filler phrases.
_FILLER = re.compile(
    r"""(?ix) ^ (?:
      (?:this\s+is\s+)?(?:a\s+|some\s+|just\s+)?(?:sample|dummy|filler|placeholder|example|test)\s+(?:text|paragraph|content|sentence)\b .{0,40}
    | (?:your|body|main|insert|add)\s+(?:own\s+)?(?:text|content|copy)\b(?:\s+(?:here|goes\s+here))?\W* | heading\s*\d*\W* | (?:sub)?title\s+(?:here|goes\s+here)\W*
    | replace\s+this\s+(?:text|paragraph|content|sentence)\b .{0,60} | (?:content|text)\s+(?:goes\s+)?(?:here|coming\s+soon)\W* | coming\s+soon\W*
    | (?:(?:blind|platzhalter|beispiel|muster)text\W*)+(?:hier\W*)? | texto\s+(?:de\s+(?:ejemplo|relleno|muestra)|simulado)\b .{0,30} | texte\s+(?:de\s+remplissage|d'exemple|factice)\b .{0,30}
    | (?:(?:text|lorem|ipsum|bla|blah|foo|bar|baz|qux|quux|asdf|jkl|qwerty|test|xxx+|dummy)\b\W*){3,}
    ) $"""
)
#: Particulars that go with a server's message; alone they are content.
_DETAIL = re.compile(
    r"""(?ix) ^ (?:
      \w*(?:error|exception)\s*: .{0,120} | file\s+"[^"]+",\s+line\s+\d+ .* | at\s+[\w.$<>]+\([^)]*\) | type:\s .{0,60} | [\w.-]+/\d+(?:\.\d+)*(?:\s*\(.*\))?
    | (?:request|reference|incident|ray|trace|error)(?:\s+(?:id|no|number|code))?\s*[:\#]?\s*[0-9a-f-]{4,} | upstream\b.{0,80}
    | directory\s+listing\b .{0,80} | it\s+(?:was|has\s+been|may\s+have\s+been)\s+(?:moved|deleted|removed)\b .{0,60}
    ) $"""
)
_LOREM = re.compile(r"(?i)\b(?:lorem|ipsum)\b")
_PLAIN_WORDS = frozenset("the a an and or of to is are in on at that with for per der die das und ist le la les et est el los y es en un une una que".split())
#: The words of the passages that filler is taken from. Those that are plain words too veto a line only if it isn't mostly made of the rest.
_LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud
    exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat
    cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem
    aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta explicabo nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos
    ratione sequi nesciunt neque porro quisquam dolorem adipisci numquam eius modi tempora incidunt magnam aliquam quaerat minima nostrum exercitationem ullam corporis suscipit
    laboriosam aliquid commodi autem vel eum iure quam nihil molestiae illum quo at vero accusamus iusto odio dignissimos ducimus blanditiis praesentium voluptatum deleniti atque corrupti
    quos quas molestias excepturi occaecati cupiditate provident similique mollitia animi dolorum fuga harum quidem rerum facilis expedita distinctio nam libero tempore cum soluta
    nobis eligendi optio cumque impedit minus quod maxime placeat facere possimus assumenda repellendus temporibus quibusdam officiis debitis necessitatibus saepe eveniet voluptates
    repudiandae recusandae itaque earum hic tenetur a sapiente delectus reiciendis voluptatibus maiores alias perferendis doloribus asperiores repellat sadipscing elitr diam nonumy
    eirmod invidunt aliquyam erat voluptua accusam justo duo rebum stet clita kasd gubergren no sea takimata sanctus vivamus vestibulum ante primis faucibus orci luctus ultrices posuere
    cubilia curae donec pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas integer maecenas nullam nunc phasellus praesent proin quisque suspendisse
    ultricies varius volutpat viverra tellus tortor tincidunt sodales semper sapien sagittis risus rhoncus pulvinar pretium porttitor pharetra ornare mauris mattis massa lectus leo
    lacus lacinia iaculis hendrerit gravida fringilla feugiat faucibus euismod eros dui dictum dapibus cursus cras convallis congue condimentum blandit bibendum augue arcu aenean class
    aptent taciti sociosqu litora torquent per conubia nostra inceptos himenaeos metus ligula nibh odio enim urna purus felis fermentum elementum efficitur interdum imperdiet""".split()
)
#: Menus, headings and footers.
_CHROME = re.compile(
    r"""(?ix) ^ (?:
      skip\s+to\s+(?:main\s+)?content | menu | search | home | log\s?in | sign\s+(?:in|up) | contact | imprint | privacy(?:\s+policy)? | toggle\s+navigation | top
    | \W*©.* | \W*copyright\s+(?:\(c\)\s*)?\d{4}.* | [^|]{1,30}(?:\s*\|\s*[^|]{1,30}){2,} | [^›»/]{1,30}(?:\s*[›»]\s*[^›»]{1,30})+
    | (?:recent|popular|related|latest|see\s+also|more|read\s+more|next|previous)\b\W .{0,60} | [*•-]\s+(?:\w+\s+){2,3}\w+
    | back\s+to\b .{0,40} | (?:zurück\s+zur?|retour\s+à|volver\s+al?)\b .{0,40} | we\s+use\s+cookies\b .{0,60} | loading\b .{0,30}
    | \#{1,6}\s .* | v?\d+(?:\.\d+)+ | re:\s .* | \[\w+\]\s .* \bticket\s+\d+ | \w+\(\d\) | [^/.]{1,30}\s/\s[^/.]{1,30}\s/\s[^/.]{1,30} | [-=_*~\#\s]+
    ) $"""
)
_HEADING = re.compile(r"#{1,6}\s")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_NUM = re.compile(r"\b(?:0x)?[0-9a-f]*\d[0-9a-f]*\b", re.I)
_NAME = re.compile(r"\b(?:\w+(?:[_-]\w+)+|(?:0x)?[0-9a-f]*\d[0-9a-f]*)\b|/[\w./-]+")


def prose_lines(text: str) -> list[str]:
    """The lines of a text without fenced code, code in backticks and HTML tags; an open fence runs to the end."""
    out, fence = [], None
    for line in re.split(r"\r\n|\r|\n", text):
        line = _QUOTE.sub("", line)
        m = _FENCE.match(line)
        if m and (fence is None or m.group(1) == fence):
            fence = None if fence else m.group(1)
            continue
        if fence is None:
            line = _TICKS.sub(" ` ", line)
            for piece in _BLOCK.split(line) if "<" in line else (line,):
                piece = _HTML.sub(" ", piece).strip()
                if piece:
                    out.append(piece)
    return out


def fields(line: str) -> list[tuple[str, str, bool]]:
    """(style, span, certain) of each span of a line that looks like an unfilled field."""
    if not _HINT.search(line):
        return []
    found = []
    table = line.startswith("|") and line.count("|") > 2
    for m in _FIELD.finditer(line):
        style, span = m.lastgroup, m.group(0)
        if style == "pipe" and table:
            continue
        sure = style not in WEAK
        if not sure:
            inner = span[1:-1].strip()
            if _ASKS.search(inner) and (" " in inner or inner.isupper()):
                sure = True
            elif not (_TITLE.match(inner) or (style == "angle" and " " in inner)):
                continue
        found.append((style, span, sure))
    if found and _CODE.search(_FIELD.sub(" ", line)):
        return []
    return found


def slot_template(line: str, spans: re.Pattern) -> tuple[str, str] | None:
    """(anchor, pattern) of a line with spans that may be unfilled slots: its longest word outside them, and what its other records match."""
    literals, at = [], 0
    for m in spans.finditer(line):
        literals.append(line[at:m.start()])
        at = m.end()
    if not at or _CODE.search(line):
        return None
    literals.append(line[at:])
    words = [w for w in "\0".join(literals).split() if "\0" not in w and re.search(r"[^\W\d_]", w)]
    anchors = [w for w in words if not re.search(r"\d", w)]
    if not anchors or (len(words) < 2 and not words[0].endswith((":", "："))):
        return None
    pattern = _VALUE.join(re.sub(r"\d+", r"\\d+", re.escape(part)) for part in literals)
    return max(anchors, key=lambda w: (len(w), w)), f"^{pattern}$"


def line_kind(line: str) -> str:
    """server, notice, filler, lorem, chrome or other; a long line is what all of its sentences are."""
    if len(line) >= 400:
        pieces = [p for p in _SENTENCE.split(line) if p]
        kinds = [line_kind(p) for p in pieces] if len(pieces) > 1 and line_kind(pieces[0]) != "other" else ["other"]
        named = [k for k in kinds if k not in ("chrome", "other")]
        if named and "other" not in kinds:
            return named[0]
    if len(line) < 400:
        if _SERVER.match(line):
            return "server"
        if _NOTICE.match(line):
            return "notice"
        if _FILLER.match(line):
            return "filler"
        if _CHROME.match(line) or _DETAIL.match(line):
            return "chrome"
    if _LOREM.search(line) and not re.search(r"\d", line) and not _plain(set(re.findall(r"\w+", line.lower()))):
        return "lorem"
    return "other"


def _plain(words: set[str]) -> bool:
    """Whether words are those of a sentence about something: a plain word among them that is no Latin, or fewer than three words of filler for each other word beside one that is."""
    plain = words & _PLAIN_WORDS
    rest = words - _PLAIN_WORDS - {"lorem", "ipsum"}
    return bool(plain) and (not plain <= _LATIN or not rest or len(rest & _LATIN) < 0.75 * len(rest))


def _mask(line: str) -> str:
    return _NAME.sub("@", line.lower())


#: Kinds of lines that name a page.
KNOWN = ("server", "notice", "filler", "lorem")


def _hash(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "big")


def _rest(lines: list[str], kinds: list[str]) -> int:
    """A sum over the different lines that tell a page from others: all but menus and footers; headings by their names."""
    body = {_mask(line) for kind, line in zip(kinds, lines) if kind != "chrome"}
    heads = {"# " + _NUM.sub("#", line.lower()) for kind, line in zip(kinds, lines) if kind == "chrome" and _HEADING.match(line)}
    return sum(map(_hash, body | heads))


_SIGN = ("doc_id", "what", "key", "filler", "style", "at", "certain")
_SIGNS = "doc_id long, what string, key string, filler string, style string, at int, certain boolean"


def _grow(lines: list[str], kinds: list[str]) -> None:
    """Mark the lines of a page of filler that share its words."""
    words = {w for kind, line in zip(kinds, lines) if kind == "lorem" for w in re.findall(r"\w{4,}", line.lower())}
    grown = bool(words)
    while grown:
        grown = False
        for i, (kind, line) in enumerate(zip(kinds, lines)):
            if kind != "other" or re.search(r"\d", line):
                continue
            own = set(re.findall(r"\w+", line.lower()))
            if own and not _plain(own) and (len(own & words) >= 0.1 * len(own) or len(own & _LATIN) >= max(3, 0.75 * len(own))):
                kinds[i], grown = "lorem", True
                words.update(w for w in own if len(w) > 3)


def _wordy(line: str) -> list[str]:
    """The different words of a line that may be filler: three or more, no number, none of a sentence."""
    if re.search(r"\d", line):
        return []
    own = set(re.findall(r"\w{4,}", line.lower()))
    return sorted(own) if len(own) > 2 and not _plain(set(re.findall(r"\w+", line.lower()))) else []


def _gapped(mask: str) -> list[str]:
    """A line, and the line but for each of its words: records that differ in one slot share one of these."""
    words = mask.split()
    return [mask, *(" ".join([*words[:i], "\0", *words[i + 1 :]]) for i in range(len(words) if 2 < len(words) < GAPPED else 0))]


def _line_signs(lines: list[str]) -> tuple[list[tuple], set[str]]:
    """(what, key, filler, style, at, certain) of the spans of a text that may be unfilled, and the lines that may show values.

    field: key is the frame, filler the span, style the pattern of filled records, at the column. slot: key is the
    anchor, filler the pattern of its line.
    """
    out: list[tuple] = []
    filled = set()
    text = "\n".join(lines)
    marked = "___" in text or "....." in text or any(hint.search(text) for hint in _SLOT_HINTS)
    for line in lines:
        spans = fields(line)
        if spans:
            frame = _NUM.sub("#", _FIELD.sub("<>", line))
            for at, (_, span, sure) in enumerate(spans):
                out.append(("field", frame, span, "", at, sure))
        if not spans and not (marked and _SLOT.search(line)):
            filled.add(line)
        elif not any(sure for _, _, sure in spans):
            if marked and (slot := slot_template(line, _SLOT)):
                out.append(("slot", *slot, "", 0, False))
        elif slot := slot_template(line, _FIELD):
            out.append(("frame", *slot, frame, 0, True))
    return out, filled


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Signs of each document: its fields, its lines of prose by hash, the words of lines that may be filler.

    The style of a line or plain row is the line itself if it can show the values of slots. The filler of a line stands
    for the other lines of its page, that of a line on no such page for all of its unknown lines; at counts the page's lines.
    known: line at of a page of known wording, under the line and the line but for each of its words. word: a word and whether it stands in filler. maybe: a word of line at of a page
    that is filler if that line is.
    """
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            lines = prose_lines(text)
            signs, filled = _line_signs(lines)
            out.extend((doc_id, *sign) for sign in signs)
            kinds = [line_kind(line) for line in lines]
            _grow(lines, kinds)
            seeded = bool(set(KNOWN) & set(kinds))
            masks = {line: _mask(line) for kind, line in zip(kinds, lines) if kind == "other"}
            strange = set(masks.values())
            out.extend((doc_id, "plain", "", "", line, 0, False) for line in filled - masks.keys())
            if seeded and not strange:
                known = sorted({_mask(line) for kind, line in zip(kinds, lines) if kind in KNOWN and kind != "lorem"})
                out.append((doc_id, "page", "", "", "", len(known), True))
                whole = f"{_hash(chr(10).join(sorted(map(_mask, lines)))):x}"
                out.extend((doc_id, "known", key, whole, "", at, True) for at, line in enumerate(known) for key in _gapped(line))
            rest = _rest(lines, kinds) if seeded and strange else _hash("\n".join(sorted(strange)))
            for line, key in masks.items():
                out.append((doc_id, "line", key, f"{(rest - _hash(key)) % 2**64:x}" if seeded else f"{rest:x}", line if line in filled else "", len(strange), seeded))
            wordy = {i: words for i, (kind, line) in enumerate(zip(kinds, lines)) if kind in ("lorem", "other") and (words := _wordy(line))}
            on = {w for i, words in wordy.items() if kinds[i] == "lorem" for w in words}
            out.extend((doc_id, "word", w, "", "", 0, w in on) for w in sorted(set().union(*wordy.values())))
            body = [i for i, kind in enumerate(kinds) if kind in ("lorem", "other")]
            if body and all(i in wordy for i in body):
                out.extend((doc_id, "maybe", w, "", "", i, len(body) == 1) for i in body for w in wordy[i])
        yield pd.DataFrame(out, columns=_SIGN)


def residue(docs: DataFrame) -> DataFrame:
    """(doc_id, reason, evidence) of each document that is residue; reason is template, page or both, joined by +.

    evidence is aligned (a column of records of one frame), repeated (lines or words of pages that come again on other
    pages), both, or alone: the corpus has no second record, its own mark or wording decides. Null, empty and blank texts
    are no cases, nor are fields in code. A document delivered twice gives one row; a null doc_id none. Further columns
    are ignored. Counts of frames, lines and words cover all documents.
    """
    texts = docs.select("doc_id", "text").where("doc_id is not null and trim(text) <> ''")
    read = texts.mapInPandas(_read, _SIGNS)
    signs = materialize(read.withColumn("key", F.when(F.col("what").isin("line", "known"), F.xxhash64("key").cast("string")).otherwise(F.col("key"))), "page-signs", ["what"])

    aligned = _aligned(signs).unionByName(_induced(signs)).distinct()
    marked = signs.where("what = 'field' and certain").select("doc_id").distinct()
    learned = _learned(signs)
    pages = learned.unionByName(_filler_pages(signs)).distinct()
    worded = signs.where("what = 'page'").select("doc_id").distinct()

    told = aligned.select("doc_id", F.lit("template").alias("r"), F.lit("aligned").alias("e")).unionByName(
        pages.select("doc_id", F.lit("page").alias("r"), F.lit("repeated").alias("e"))
    ).unionByName(marked.select("doc_id", F.lit("template").alias("r"), F.lit(None).cast("string").alias("e"))).unionByName(
        worded.select("doc_id", F.lit("page").alias("r"), F.lit(None).cast("string").alias("e"))
    )
    joined = lambda c: F.concat_ws("+", F.sort_array(F.collect_set(c)))
    return told.groupBy("doc_id").agg(joined("r").alias("reason"), F.coalesce(F.nullif(joined("e"), F.lit("")), F.lit("alone")).alias("evidence"))


def _aligned(signs: DataFrame) -> DataFrame:
    """(doc_id) of the fields in a column that other documents fill otherwise: with another span, or with plain words."""
    found = signs.where("what = 'field'").select("doc_id", "key", "at", "filler", "certain")
    values = found.groupBy("key", "at", "filler").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    columns = values.groupBy("key", "at").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).where("n >= 2 and a < b")
    varied = found.join(columns.select("key", "at"), ["key", "at"], "left_semi").select("doc_id")
    # frames whose columns don't change among the open records: is there a record that is filled in?
    lone = signs.where("what = 'frame'").select("doc_id", F.col("key").alias("anchor"), F.col("filler").alias("pattern"), F.col("style").alias("key"))
    lone = lone.join(columns.select("key").distinct(), "key", "left_anti")
    return varied.unionByName(_matched(signs, lone, 1))


def _induced(signs: DataFrame) -> DataFrame:
    """(doc_id) of the slots whose places SLOT_VALUES other lines or more fill with plain words."""
    open_slots = signs.where("what = 'slot'").select("doc_id", F.col("key").alias("anchor"), F.col("filler").alias("pattern"))
    return _matched(signs, open_slots, SLOT_VALUES)


def _matched(signs: DataFrame, opened: DataFrame, times: int) -> DataFrame:
    """(doc_id) of the open lines (doc_id, anchor, pattern) whose pattern so many different filled lines match."""
    templates = materialize(opened.select("anchor", "pattern").distinct(), "page-slots")  # written, so that Spark knows its size before it moves the words
    if templates.isEmpty():
        return opened.select("doc_id").limit(0)
    plain = signs.where("what in ('line', 'plain') and style <> ''").select(F.col("style").alias("line"))
    words = plain.select("line", F.explode(F.array_distinct(F.split("line", r"\s+"))).alias("anchor"))
    shown = words.join(templates, "anchor").where("line rlike pattern").groupBy("anchor", "pattern").agg(F.count_distinct("line").alias("n"))
    return opened.join(shown.where(F.col("n") >= times), ["anchor", "pattern"], "left_semi").select("doc_id")


def _learned(signs: DataFrame) -> DataFrame:
    """(doc_id) of the pages all of whose lines belong to page templates of the corpus."""
    lines = signs.where("what = 'line'").select("key", "filler", "certain").distinct()
    shares = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("certain").alias("on")).where((F.col("on") >= LINE_TIMES) & (F.col("on") >= LINE_SHARE * F.col("n")))
    seeded = signs.where("what = 'line' and certain").select("doc_id", "key", "filler").distinct()
    strange = _repeated(seeded, shares.select("key"))
    # pages without any known wording, made of lines that the others have taught
    taught = strange.select("key").distinct()
    bare = signs.where("what = 'line' and not certain").select("doc_id", "key", "at").distinct().join(taught, "key", "left_semi")
    bare = bare.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at")).where("n = at").select("doc_id")
    # pages of known wording only: all their lines come again on other pages, with the same or another word in a slot
    known = signs.where("what = 'known'").select("doc_id", "key", "filler", "at")
    times = known.groupBy("key").agg(F.min("filler").alias("a"), F.max("filler").alias("b")).where("a < b").select("key")
    again = known.join(times, "key", "left_semi").select("doc_id", "at").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    whole = signs.where("what = 'page'").groupBy("doc_id").agg(F.max("at").alias("at")).join(again, "doc_id").where("n = at").select("doc_id")
    return strange.select("doc_id").unionByName(bare).unionByName(whole)


def _filler_pages(signs: DataFrame) -> DataFrame:
    """(doc_id) of the pages all of whose prose is made of the words of filler."""
    words = signs.where("what = 'word'").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("certain").alias("on"))
    filler = words.where((F.col("on") >= WORD_TIMES) & (F.col("on") >= WORD_SHARE * F.col("n"))).select("key", F.lit(1).alias("f"))
    maybe = signs.where("what = 'maybe'").select("doc_id", "at", "key").distinct()
    # only lines with a word of filler matter: those come first, so that few lines are counted
    touched = maybe.join(filler.select("key"), "key", "left_semi").select("doc_id").distinct()
    lines = maybe.join(touched, "doc_id", "left_semi").join(filler, "key", "left").groupBy("doc_id", "at").agg(F.avg(F.coalesce("f", F.lit(0))).alias("share"))
    return lines.groupBy("doc_id").agg(F.min("share").alias("least")).where(F.col("least") >= FILLER_SHARE).select("doc_id")


def _repeated(seeded: DataFrame, keys: DataFrame) -> DataFrame:
    """The lines of those pages whose unknown lines are all repeated: on LINE_TIMES pages of this very set that differ in their other lines.

    Pages with any other line leave, and the rest are counted anew until none leaves.
    """
    left = materialize(seeded.join(keys, "key", "left_semi").unionByName(seeded.join(keys, "key", "left_anti").withColumn("key", F.lit(None).cast("string"))), "page-lines")
    n = left.count()
    while n:
        again = left.groupBy("key").agg(F.count_distinct("filler").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where((F.col("n") >= LINE_TIMES) & (F.col("a") < F.col("b")))
        content = left.join(again, "key", "left_anti").select("doc_id")
        kept = materialize(left.join(content, "doc_id", "left_anti"), "page-lines")
        drop_scratch(left)
        left, before = kept, n
        n = left.count()
        if n == before:
            break
    return left


def without_residue(docs: DataFrame) -> DataFrame:
    """The documents that are no residue, with all their columns; null, empty and blank texts stay."""
    bad = residue(docs).select(F.col("doc_id").alias("__bad"))
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")
