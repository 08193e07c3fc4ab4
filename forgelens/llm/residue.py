"""Template residue, filler, error pages and script notices among texts.

Code (fenced, indented, inline), quotations and quoted strings are taken out first: what a text shows
or quotes is no residue. Error bodies in JSON, XML or HTML are judged before that, by their structure.
The rest falls into lines, sentences and the parts between dashes or bars; each is normalised (numbers,
addresses, dates and hex codes masked, case and blanks folded) and judged by rules. A rule of words runs
only where one automaton pass over the message meets one of its cues.

Placeholder rules know delimiters round a name, not names. Phrase rules combine what fails (a page, a
request, a right) with how it fails. A strong message decides by itself. A weak one is a phrase that
prose has too; it counts where the text holds nothing else, beside page furniture or beside another
weak message of its paragraph, or where its masked form, as a line of its own, recurs widely: in at
least ``RECUR_DOCUMENTS`` documents of at least ``RECUR_SOURCES`` sources, counted by exact hash over all.

Defined cases: null, empty and blank texts are never found; repeated rows are found alike, in one row a
``doc_id``; a null source counts as a source and rows with a null ``doc_id`` as one document; very long
texts are read whole; nothing but ``doc_id``, ``text`` and ``source`` is read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.session import cut

RECUR_DOCUMENTS, RECUR_SOURCES = 3, 2

L = r"[^\W\d_]"  # a letter
# Words that name a slot; they tell a slot from a word in brackets where the delimiters alone do not.
SLOT = r"(?:your|insert|add|enter|fill|name|title|version|date|year|company|org|organi[sz]ation|team|author|maintainer|owner|holder|licen[cs]e|url|link|email|e-mail|address|phone|city|country|customer|client|user|product|amount|price|description|summary|project|repo|repository|screenshot|here|buraya|yazın|hier|einfügen|aquí|insertar|ici|todo|tbd)"
UPPER = r"[A-ZÀ-ÖØ-ÞĞİŞ][A-ZÀ-ÖØ-ÞĞİŞ\d]+(?:[_ -][A-ZÀ-ÖØ-ÞĞİŞ\d]+)*"
SLOTTED = rf"(?i:[\w .\-]*?(?<!{L}){SLOT}(?!{L})[\w .\-]*|[\w .\-]*[_.]{SLOT}|{SLOT}[_.][\w .\-]*)"
IDENT = rf"{L}[\w.\-]*(?: [\w.\-]+)*"
HTML = r"(?:a|abbr|article|b|body|br|center|code|dd|del|details|div|dl|dt|em|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|kbd|li|link|main|meta|nav|noscript|ol|option|p|pre|script|section|select|small|span|strong|style|sub|summary|sup|table|tbody|td|th|thead|title|tr|u|ul|video|error|code|message|resource|requestid)"

TAGS = r"(?:WIP|RFC|DRAFT|BUG|FEATURE|DONE|FIXED|CLOSED|SOLVED|OK|FAIL(?:ED)?|PASS(?:ED)?|SKIP(?:PED)?|INFO|WARN(?:ING)?|ERROR|DEBUG|NOTE|TIP|IMPORTANT|CAUTION|UPDATE|EDIT|HELP|QUESTION|DEPRECATED|REVIEW|BLOCK|CI|API|UI|SPAM)"  # labels people set in brackets

# Delimiters round a name: doubled or mixed ones hold any name, single ones a name in capitals or of a slot.
# Each stands with the text a line must hold for it.
PLACEHOLDERS = tuple((sign, re.compile(p)) for sign, p in (
    ("{{", r"\{\{[^{}]+\}\}"), ("{%", r"\{%[^{}%]+%\}"), ("<%", r"<%[^<>%]+%>"), ("<?=", r"<\?=[^<>?]+\?>"), ("${", rf"\$\{{{IDENT}\}}"), ("#{", rf"#\{{{IDENT}\}}"), ("{$", rf"\{{\${IDENT}\}}"), ("{!", rf"\{{!{IDENT}!?\}}"),
    ("{#", rf"\{{#{IDENT}#?\}}"), ("[%", r"\[%[^\[\]%]+%\]"), ("%(", rf"%\({IDENT}\)[sdifr](?!\w)"), ("@@", rf"@@{IDENT}@@"), ("$$", rf"\$\${IDENT}\$\$"), ("%%", rf"%%{IDENT}%%"), ("##", rf"##{IDENT}##"), ("<<", rf"<<{IDENT}>>"),
    ("*|", rf"\*\|{IDENT}\|\*"), ("«", rf"«(?:{UPPER}|{SLOTTED})»"),
    ("{", rf"(?<![\w\\$_^{{])\{{(?:\d|{SLOTTED}|{UPPER}|{L}[^\W_ ]*(?: [^\W_]+)*[_.][^\W\d_][\w.]*|[^\W\d_]{{4,20}})\}}(?![\w}}])"),
    ("<", rf"(?<![\w<])<(?!/?{HTML}[\s/>])(?:{SLOTTED}|{UPPER})>(?!>)"), ("[", rf"(?<![\w\[!])\[(?!{TAGS}\])(?:{UPPER}|{SLOTTED})\](?![(\[:\w])"), ("[[", rf"\[\[(?:{SLOTTED}|{UPPER})\]\]"),
    ("((", rf"\(\((?:{SLOTTED}|{UPPER}|{L}+[_.][\w.]+)\)\)"), ("__", rf"(?<![\w_])__(?:{UPPER}|{SLOTTED})__(?![\w_])"), ("%", rf"(?<![\w%])%(?:{UPPER}|{SLOTTED})%(?![\w%])"), ("$", rf"(?<![\w$])\$(?:{UPPER}|{SLOTTED})\$(?![\w$])"),
    ("~", rf"(?<![\w~])~(?:{UPPER}|{SLOTTED})~(?![\w~])"), ("^", rf"(?<![\w^])\^(?:{UPPER}|{SLOTTED})\^(?![\w^])"), ("!", rf"(?<![\w!])!(?:{UPPER})!(?![\w!])"), ("[object", r"\[object Object\]"),
    ("%", r"(?<![\w%])%[sd](?!\w).*(?<![\w%])%[sd](?!\w)"), ("%", r"(?i)(?<!\w)(?:dear|hello|hi|hey|welcome|copyright|hallo|hola|merhaba|bonjour|sayın)(?: to)? %[sd@](?!\w)"),
    ("NaN", r"(?<!\w)NaN(?:[-/.]NaN)+(?!\w)"), ("XXX", r"(?<!\w)X{3,}(?!\w)"), ("___", r"(?i)(?<!\w)(?:name|date|title|author|version|signature|company|address|email|phone|by) *: *_{3,}|(?<![\w_])_{5,}(?![\w_])"),
    ("<!--", r"(?i)<!-- *(?:describe|list|explain|add|write|fill|insert|replace|what|please|delete|remove|provide|enter|put|include|your)(?!\w)"),
))
BARRED = re.compile(rf"(?<![\w|])\|(?:{UPPER}|{SLOTTED})\|(?![\w|])")


class Rule(NamedTuple):
    kind: str
    strong: bool
    cues: str  # words of which the message must hold one, by blanks; _ stands for a blank
    pattern: re.Pattern


def _rule(kind: str, strong: bool, cues: str, pattern: str) -> Rule:
    return Rule(kind, strong, cues, re.compile(pattern))


# What fails on the web; a \w+ in a rule takes any noun instead, where the rest of the phrase is plain enough.
WEB = r"(?:web ?pages?|page|site|website|web ?server|servers?|url|web address|address|link|host|hostname|wiki|repository|repo|view|request|resource|gateway|upstream|backend|origin|domain|service)"
FIRST = r"^(?:(?:oops|sorry|uh[- ]?oh|whoops|hmm|unfortunately|apologies|error|warning|notice|http|attention|erreur|fehler|hata|ошибка|エラー|错误)\b[\s,.!:;#-]*)*"
END = r"[\s.!…:;)\]]*$"
# Reason phrases of status codes, as registered, and the usual ones beside them.
REASON = (
    r"(?:bad request|unauthori[sz]ed|payment required|forbidden|(?:page |file |url |object )?not found|method not allowed|not acceptable|proxy authentication required|request time-?out|conflict|gone|length required|precondition failed|"
    r"payload too large|content too large|uri too long|unsupported media type|range not satisfiable|expectation failed|i.m a teapot|misdirected request|unprocessable (?:content|entity)|locked|failed dependency|too early|upgrade required|"
    r"precondition required|too many requests|request header fields too large|unavailable for legal reasons|(?:internal )?server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|http version not supported|"
    r"insufficient storage|loop detected|network authentication required|moved permanently|moved temporarily|access denied|permission denied|bad credentials|invalid request|request blocked|request rejected|origin (?:is )?unreachable|"
    r"(?:the )?web server is (?:down|offline)|connection (?:timed out|refused|reset|closed)|site (?:is )?(?:offline|unavailable)|slow ?down|no such key|application error|proxy error|fatal error|unknown error|dns (?:error|resolution error)|ssl handshake failed)"
)
TALK = re.compile(
    r"(?<!\w)(?<!be )(?:fix(?:ed|es)?|add(?:ed|s|ing)?|removed|removes|replaced|changed|solved|solves|handle[ds]|answers|answered|printed|prints|renders|rendered|shows|showed|says|said|lists|returns|returned|raises|raised|throws|threw|logs|logged|caught|catch(?:es)?|"
    r"retried|retries|reproduced?|scrap(?:e|es|ed|ing)|crawl\w*|regex|changelog|merged?|bug|we now|now (?:says|stops|shows|returns|uses|lists|reads)|i (?:get|got|see|saw|think|removed|added|wrote)|reviewers?|refactor\w*|patch|"
    r"no longer (?:blocks|needs)|instead of|so that|only sorting|still)(?!\w)"
)  # words of people who talk about such messages

RULES = (
    # a fill gone wrong
    _rule("placeholder", True, "undefined null none nan invalid_date", r"(?<!\w)(?:released|written|maintained|created|by|dear|hello|hi|hey|welcome|welcome to|version|named?|copyright) (?:undefined|null|none|nan|invalid date)(?!\w)"),
    _rule("placeholder", True, "dear_, hello_, hi_, dear, hello, hi, hey, hallo, hola, merhaba, bonjour, sayın,", r"^(?:dear|hello|hi|hey|hallo|hola|merhaba|bonjour|sayın)(?: ,|,,)$|^(?:dear|sayın),$"),
    # status structures: a code or a reason phrase that makes up the message
    _rule("error_page", True, "request authori forbidden found allowed acceptable required time conflict gone failed large long unsupported satisfiable teapot unprocessable locked early unavailable error gateway implemented storage loop moved denied credentials blocked rejected unreachable down offline refused reset closed timed down key", rf"{FIRST}(?:(?:status|code)\W*)*#? ?[-–—:|,.]* ?(?:error ?[:-]? ?)?{REASON}(?: error)?(?: ?[(:–-]+ ?(?:error )?#\)?)?(?: (?:nginx|apache|cloudflare|openresty|iis|varnish|envoy|\w*serv\w*)\S*)?{END}|^(?:application|fatal|server|proxy|gateway) error:? (?:a|an|the|uncaught|while|in|on) .*"),
    _rule("error_page", True, "error http status fehler erreur hata ошибка エラー 错误", r"^(?:\W*(?:oops|sorry)\W+)?(?:http|error|status|fehler|erreur|hata|ошибка|エラー|错误)(?: ?(?:code|status|error|kodu|no))?[ :#-]*#(?:\W*$|\s*[:–—.-]\s*\S.*$)"),
    _rule("error_page", True, "error fehler erreur hata ошибка", r"^#(?: -|:)? (?:error|fehler|erreur|hata|ошибка)\W*$|^[^.]{2,60}\((?:error|fehler|erreur|hata|ошибка) #\)\W*$"),
    _rule("error_page", True, "err_ econn enotfound", r"(?<!\w)err_[a-z]+(?:_[a-z]+)*(?!\w)"),
    # a page or thing asked for that is not there
    _rule("error_page", True, "you", r"^(?:\W*(?:oops|sorry|unfortunately)\W+)?(?:the|this|that|a) \w+(?: \w+)? (?:that )?you(?: a|.)re (?:looking|searching|trying)|(?:page|wiki|\w+) (?:that )?you (?:are looking for|were looking for|(?:have )?requested|tried to (?:open|reach|access|visit|view)|want(?:ed)?) (?:does not|doesn.t|do not|could ?n.t|could not|cannot|can.t|has been|have been|was|is|no longer|may|might)"),
    _rule("error_page", True, "moved available", r"has (?:been )?(?:moved|removed|deleted) or is no longer|(?:has|have|may have|might have) been (?:moved|removed|deleted|renamed)(?: or|, )(?: has been| been)? ?(?:moved|removed|deleted|renamed|does not exist)|is no longer (?:available|here|online) (?:at|on|under) this (?:address|url|location|site|server)"),
    _rule("error_page", True, "address here link url", r"(?:nothing|no page|no such page|no content) (?:exists |found |lives |was found )?(?:here|at (?:this|that) (?:address|url|location))|(?:link|url|address) (?:may|might|could) be (?:mistyped|misspelled|broken|wrong|outdated|out of date)|(?:link|bookmark|url) (?:is|seems|appears)(?: to be)? (?:dead|broken|out of date|outdated|invalid)" + END),
    _rule("error_page", True, "could_not cannot can't unable failed_to couldn", rf"{FIRST}(?:we |the server |this server |our servers? )?(?:(?:were |was |are )?(?:unable to|could not|couldn.t|cannot|can.t|failed to)) (?:find|locate|load|display|show|open|reach|handle|process|connect to|complete|serve) (?:the |this |that |your |any )?(?:\w+ )?{WEB}"),
    _rule("error_page", True, "could_not couldn cannot can't can_not was_not could_no unable_to not_available", rf"{FIRST}(?:the|this|that|your) (?:\w+ )?{WEB}(?: for \w+)? (?:could not|couldn.t|cannot|can.t|can not|was not|could no longer) (?:be )?(?:found|located|shown|displayed|opened|loaded|reached|processed|completed|served|handled|satisfied|fulfilled)|^unable to connect(?: to (?:the|this|our) (?:server|database|host|site|service))?{END}|not available in your (?:country|region|area|location)"),
    _rule("error_page", True, "servers", r"our servers? (?:could not|cannot|can.t|are|is) (?:handle|process|unable|overloaded|busy|too busy|down)"),
    _rule("error_page", True, "exist", rf"{FIRST}(?:the|this|that) (?:\w+ )?{WEB} (?:does not|doesn.t|no longer) exists?{END}"),
    # the server fails
    _rule("error_page", True, "wrong", r"(?:something|things?) (?:went|has gone|have gone|seems to have gone) (?:\w+ )?wrong(?: on our (?:side|end|servers?)| while (?:loading|processing|handling) (?:the|this|your) \w+)?(?:\W|$)"),
    _rule("error_page", True, "occurred encountered unexpected", r"^(?:\W*(?:oops|sorry)\W+)?an? (?:\w+ )?(?:unexpected|unknown|internal|fatal|server|application|system) ?(?:error|problem|exception|condition)?(?: error| problem)? (?:has )?occurred|server (?:met|encountered|returned|had|ran into) an? (?:\w+ )?(?:unexpected|internal|unknown|invalid|empty|error)"),
    _rule("error_page", True, "unavailable down offline service maintenance unreachable overloaded available", rf"{FIRST}(?:the |this |that |our |your )?(?:\w+ )?{WEB} (?:is|are|was|has been) (?:currently |temporarily |now )*(?:unavailable|down|offline|out of service|not available|not reachable|unreachable|overloaded|under maintenance|undergoing maintenance|taking a (?:short )?break)(?: for maintenance)?(?:{END}|[,;.] )"),
    _rule("error_page", True, "unavailable service offline maintenance construction", rf"^\W*(?:temporarily (?:out of service|unavailable|offline)|(?:service|site|page|repository|website) (?:temporarily )?(?:unavailable|offline)|(?:scheduled |planned )?maintenance (?:in progress|mode|work)|down for (?:scheduled )?maintenance|(?:site )?under (?:construction|maintenance)){END}"),
    _rule("error_page", True, "maintenance upgrading back break", r"(?:^|\W)we(?: a|.)re (?:currently |temporarily )?(?:upgrading|updating|performing|undergoing|doing|carrying out|down for|offline for) (?:\w+ ){0,3}(?:systems?|servers?|site|maintenance|upgrades?|work)|(?:will|we.ll) be (?:right back|back (?:soon|shortly|in a))(?:\W|$)|(?:service|site|website|server) is taking a (?:short )?break|^(?:this|the|our) \w+ is (?:undergoing|down for|closed for|in) (?:\w+ )?maintenance"),
    _rule("error_page", True, "answer respond long reached", rf"^(?:the|our|this) (?:\w+ )?(?:host|server|upstream|origin|backend|gateway|site|page|service) (?:did not|didn.t|does not|failed to|is not|took too long to) (?:respond(?:ing)?|answer|reply|load)"),
    _rule("error_page", True, "timed", rf"^\W*(?:the |your )?(?:connection|gateway|request|operation|page|server|session)(?: has)? timed out{END}|^your (?:connection|request|session) (?:to \S+ )?(?:has )?timed out"),
    # no right, too often, expired
    _rule("error_page", True, "permission access authori allowed privileges rights forbidden", r"^(?:[\w# ]{2,40} - |\W*(?:oops|sorry)\W+)?you(?: a|.)?(?:re| do)?(?: not|n.t| have no| lack)(?: currently)?(?: have)?(?: the| any| sufficient| enough| necessary| required)* ?(?:access|permissions?|privileges|rights|authori[sz]ed|allowed)(?: to (?:view|open|see|access|use|visit|enter|edit|read|perform))? ?(?:to )?(?:this|that|the requested)?(?: \w+){0,2}" + END),
    _rule("error_page", True, "access denied", rf"{FIRST}(?:your )?access (?:to (?:this|the) (?:\w+ )?\w+ )?(?:(?:is|has been|was) )?(?:denied|forbidden|restricted|blocked|not allowed){END}|^\W*access denied\W+you "),
    _rule("error_page", True, "many requests visitors attempts limit quota wait", rf"^(?:[\w# ]{{2,40}} - |\W*(?:oops|sorry)\W+)?(?:there (?:are|were) )?too many (?:requests|visitors|attempts|connections|users|login attempts|redirects)(?: at once| from (?:this|your) \w+(?: \w+)?| right now)?(?:[.;!]| - |$)|(?:rate|request|api) limit (?:has been )?(?:exceeded|reached){END}|you (?:have|.ve)? ?(?:used up|exceeded|reached|hit) your (?:\w+ )?(?:quota|limit|rate|allowance)|^wait # (?:seconds|minutes) (?:and|before|then) "),
    _rule("error_page", True, "disabled suspended owner blocked administrator", rf"^(?:[\w# ]{{2,40}} - )?(?:this|the|your) \w+ (?:was|has been|is) (?:disabled|suspended|blocked|removed|taken down|deleted|archived|banned)(?: (?:by|at the request of) (?:its|the|an?|our) (?:owner|administrators?|admins?|moderators?|staff|author))(?: .*)?{END}|^(?:this|your) account (?:was|has been|is) (?:disabled|suspended|blocked|deleted){END}"),
    _rule("error_page", True, "told notified", r"we (?:have|.ve) been (?:told|notified|informed) (?:about|of) (?:it|this|the)|our (?:team|engineers|administrators) (?:have|has) been (?:notified|informed)"),
    # other languages
    _rule("error_page", True, "seite datei server zugriff berechtigung fehler wartung sitzung anfragen zeitüberschreitung dienst schief", rf"(?:^|\W)(?:die|diese|der|dieser)? ?(?:angeforderte |gesuchte |gewünschte |aufgerufene )?(?:web)?(?:seite|adresse|ressource|dienst|server|service)(?: \w+)? (?:(?:wurde|ist|konnte|antwortet|existiert)(?: \w+)? )?(?:nicht (?:gefunden|verfügbar|erreichbar|mehr verfügbar)|existiert nicht(?: mehr)?|antwortet nicht)|interner serverfehler|zugriff (?:verweigert|nicht (?:erlaubt|gestattet))|sie haben keine(?:n)? (?:berechtigung|zugriff)|^wartungsarbeiten|es ist ein (?:\w+ )?fehler aufgetreten|etwas ist schief|ihre sitzung ist abgelaufen|^zu viele anfragen|^zeitüberschreitung"),
    _rule("error_page", True, "página pagina enlace error acceso permiso mantenimiento algo sesión solicitudes servidor servicio recurso toegang stron", r"p[áa]gina (?:que busca |solicitada )?(?:no (?:se )?(?:encontrada|encontró|encuentra|existe|disponible|está disponible|se ha encontrado|ha sido)|não encontrada|non trovata|niet gevonden)|pagina is niet gevonden|toegang geweigerd|(?:nie znaleziono strony|strona nie (?:istnieje|została znaleziona))|el enlace (?:está|esté|puede estar) roto|error (?:interno|del) (?:del )?servidor|(?:acceso|acesso|accesso) (?:denegado|prohibido|restringido|negado|negato)|no tiene (?:permisos?|acceso)|(?:sitio|servicio|servidor|página) (?:está )?en mantenimiento|^algo (?:salió|ha salido|fue) mal|(?:ha ocurrido|se produjo|se ha producido|ocurrió) un error|su sesión ha (?:caducado|expirado)|^demasiadas solicitudes|(?:servidor|servicio|recurso) (?:no (?:está )?(?:disponible|responde|encontrado))"),
    _rule("error_page", True, "page accès erreur maintenance session requêtes serveur service ressource délai autorisation", r"(?:page|ressource|fichier|site|adresse) (?:demandée? |que vous cherchez )?(?:est )?(?:introuvable|non trouvée?|indisponible|n.existe (?:pas|plus))|accès (?:refusé|interdit|non autorisé)|vous n.(?:avez pas|êtes pas) (?:l.autorisation|la permission|accès|le droit|les droits|autorisé)|erreur (?:interne|du) (?:du )?serveur|(?:site|service|serveur) (?:est )?(?:en (?:cours de )?maintenance|indisponible)|une erreur (?:est survenue|s.est produite)|votre session a expiré|^trop de requêtes|^délai d.attente dépassé"),
    _rule("error_page", True, "sayfa sunucu erişim izn yetki bakım hata oturum istek aşımı kaynak", r"(?:aradığınız )?(?:sayfa|kaynak|site|adres)(?:ya|yı|ye)? (?:bulunamadı|mevcut değil|bulunmuyor|kaldırıl\w+|taşınmış|silinmiş)|aradığınız (?:sayfa|\w+)|sunucu (?:hatası|yanıt vermiyor)|erişim (?:engellendi|reddedildi|yasak\w*|izniniz yok)|(?:görüntüleme|erişim)? ?(?:izniniz|yetkiniz) (?:yok|bulunmuyor)|bakım (?:çalışması|nedeniyle|modu)|(?:bir şeyler ters gitti|bir hata oluştu|beklenmeyen bir hata)|oturumunuz(?:un)? (?:sona erdi|süresi doldu|zaman aşımına)|^çok fazla istek|^zaman aşımı"),
    _rule("error_page", True, "страниц доступ ошибк работ сесси запрос сервер сайт прав", r"(?:страниц\w+|ресурс|сайт|адрес) (?:\w+ )?(?:не найден\w*|недоступ\w+|не существует|удал[её]н\w*|перемещен\w*)|доступ (?:запрещ[её]н|закрыт|ограничен)|у вас нет (?:прав|доступа|разрешения)|(?:внутренняя )?ошибка (?:сервера|сервер)|(?:технические|профилактические) работы|что-то пошло не так|произошла (?:\w+ )?ошибка|(?:сессия|срок \w+ сессии) (?:истекла|ист[её]к)|^слишком много запросов|сервер (?:не отвечает|временно недоступен)"),
    _rule("error_page", True, "页 訪 访 权 错 维护 频繁 过期 服务器 网站 链接 找不到 ページ サーバ サイト アクセス エラー メンテナンス セッション 頁 페이지", r"(?:页面|网页|頁面|资源|链接|网站|页).{0,10}(?:不存在|未找到|找不到|无法(?:访问|显示|打开)|不可用|已(?:被)?删除|已失效)|找不到.{0,6}(?:页面|网页|页|内容)|访问(?:被拒绝|受限)|(?:没有|无)(?:访问)?权限|服务器(?:内部)?(?:错误|出错|繁忙|超时|无响应)|(?:系统|网站)(?:正在)?维护|(?:请求|访问)(?:过于|太)频繁|出错了|会话.{0,4}过期|(?:ページ|サイト|ファイル).{0,12}(?:見つかりません|存在しません|表示できません|移動|削除)|お探しのページ|アクセス(?:が拒否|できません|権限がありません)|サーバー?(?:内部)?(?:エラー|が応答)|メンテナンス(?:中|のため)|エラーが発生(?:しました)?|セッション.{0,6}(?:切れ|期限)|페이지를 찾을 수 없"),
    # scripts, browsers and robots
    _rule("script_notice", True, "javascript java_script scripts scripting js", r"(?:^|please |must |(?:need|have|has) to |should |to (?:continue|proceed|use|view|see) \w*,? ?)(?:enable|activate|turn on|switch on|allow|permit|re-?enable)(?: the use of| support for)? (?:java ?script|scripts|scripting|js)(?!\w)|(?:java ?script|scripts|scripting)(?: and cookies)? (?:is|are|must be|has to be|have to be|needs? to be|seems? to be|appears? to be)(?: currently)? (?:disabled|required|turned (?:off|on)|switched (?:off|on)|off|blocked|needed|enabled|allowed|necessary|not (?:enabled|available|supported|allowed))(?: (?:in|by|on|for|to) (?:your|this|the) .*|\W*)$|^(?:java ?script|scripts?|scripting)(?: is)? (?:required|needed|disabled|blocked)\W*$|(?:^|please )(?:turn|switch) (?:java ?script|scripts|scripting)(?: back)? on(?!\w)"),
    _rule("script_notice", True, "javascript java_script scripts scripting", r"^(?:\W*sorry\W+)?(?:this|the|our|\w+) (?:\w+ ){0,2}(?:needs|requires|relies on|depends on|uses|only works with|works only with|will only work with|needs to run|won.t work without|(?:does|do|will|can|may)(?: ?not|n.t) (?:work|run|load|function|be (?:shown|displayed|used|viewed))(?: \w+){0,2} without) (?:java ?script|scripts|scripting)(?: (?:to|in|enabled|support|turned on|being).*|\W*)$|without (?:java ?script|scripts) (?:this|the|our) \w+ (?:cannot|can.t|will not|won.t|does not|doesn.t)"),
    _rule("script_notice", True, "browser", r"^(?:\W*sorry\W+)?your (?:web )?browser (?:blocks|is not supported|isn.t supported|does not|doesn.t|has (?:java ?script|scripts|scripting|cookies)|is (?:out of date|outdated|too old|unsupported)|must|needs to|seems? to)|checking (?:your|the) browser|^please (?:upgrade|update|switch) (?:to a (?:modern|newer|different)|your) (?:web )?browser|(?:no ?script|java ?script) .* your browser"),
    _rule("script_notice", True, "robot human captcha security_check blocked", r"^(?:\W*sorry\W+)?you have been blocked\W*$|^human verification(?: required| needed)?\W*$|^(?:performing|running) (?:a )?security check|(?:verify|verifying|confirm|prove|check(?:ing)?|make sure)(?: that| whether| if)? (?:you(?: a|.)re|you are) (?:not a (?:robot|bot)|(?:a )?human)|(?:complete|solve|fill in) the (?:captcha|security check|challenge)|^(?:i.m|i am) not a robot\W*$|^are you (?:a robot|human)"),
    _rule("script_notice", True, "ddos moment traffic cookies reload scripts nothing_happens", r"ddos protection by|unusual traffic from your|^(?:scripts and )?cookies (?:and (?:scripts|java ?script) )?(?:must|need to|have to) be (?:allowed|enabled|turned on)|^(?:please )?(?:enable|allow|accept) cookies(?: and reload.*| to continue.*|\W*)$|^if nothing happens, (?:allow|enable|click|reload)"),
    _rule("script_notice", True, "javascript java_script scripts skript скрипт", r"(?:aktivier\w*|einschalten|erlauben|zulassen|benötigt|erfordert|erforderlich|deaktiviert|habilit\w*|activ[aeoéz]\w*|permit\w*|autoris\w*|désactivé|nécessite|requiere|necesita|etkinleştir\w*|açın|açmanız|gerek\w*|kapalı|включ\w*|разреш\w*|отключ\w*|требует\w*|ative|abilit\w*|attiv\w*|schakel|inschakelen|włącz\w*|启用|开启|允许|打开|禁用|有効|許可|無効|必要)[^.]{0,40}(?:java ?script|scripts|skripte|скрипт)|(?:java ?script|scripts|skripte|скрипт\w*)[^.]{0,40}(?:aktivier\w*|einzuschalten|erlauben|zulassen|benötigt|erforderlich|deaktiviert|habilit\w*|activé|activad\w*|desactivado|nécessaire|requis|etkinleştir\w*|açın|gerek\w*|kapalı|включ\w*|отключ\w*|требуется|włącz\w*|启用|开启|允许|打开|禁用|有効|許可|無効|必要)"),
    # filler and instructions of templates
    _rule("placeholder", True, "added written provided inserted completed defined announced determined", rf"(?:description|content|text|details?|section|title|summary|chapter|paragraph|documentation|[\w#]+:) (?:(?:is|are) )?(?:(?:to|will|must|should) be|still to be|yet to be) (?:added|written|provided|inserted|completed|filled in|filled|defined|announced|determined)(?: (?:here|later|soon|by .*))?{END}|^(?:to be|will be) (?:added|written|provided|inserted|completed|defined|announced|determined|filled in){END}"),
    _rule("placeholder", True, "replace delete remove", r"^(?:please )?(?:replace|delete|remove|overwrite|edit) (?:this|the following|these) (?:paragraph|text|section|line|lines|block|sentence|placeholder|comment|content|template|instructions?)"),
    _rule("placeholder", True, "here", rf"(?:your|sample|example|some|dummy|placeholder|main|short|the) (?:\w+ )?(?:content|text|description|title|name|message|summary|logo|image|copy|heading|headline|caption|abstract|introduction)(?: (?:goes|comes|should go|will go|should be|will be|to go))? here|(?:text|content|description|title|copy|logo|image|headline|screenshot|name|summary) (?:goes|comes|should go|will go) here|^(?:please )?(?:insert|add|enter|put|write|type|fill in|describe|provide|paste|place|say|explain) (?:[\w'-]+ ){{1,6}}here{END}"),
    _rule("placeholder", True, "todo tbd fixme tba", rf"^\W*(?:todo|tbd|fixme|tba)\b\W*(?:write|add|describe|fill|insert|explain|complete|document|provide|list|finish|replace)(?!\w)|^\W*(?:tbd|tba){END}"),
    _rule("placeholder", True, "placeholder place-holder dummy sample filler blindtext", r"^\W*(?:this is )?(?:just )?(?:an? |some )?(?:place-?holder|dummy|filler)(?: \w+)?(?: (?:text|content|copy|paragraph|image|title))?\W*$|^\W*(?:this is )?(?:just )?(?:an? |some )?(?:sample|example) (?:text|content|copy|paragraph|title|heading)\W*$"),
    _rule("placeholder", True, "soon construction to_come", rf"^(?:\w+ ){{0,3}}(?:coming soon|to come){END}|^(?:this (?:page|section|site|document) is )?under construction{END}"),
    _rule("placeholder", True, "text ersetzen ausfüllen metin metni açıklama texto texte platzhalter beschreibung текст описание 文本 テキスト 文字 说明 buraya aquí ici hier blindtext 在此 此处 ここに 占位 示例 ダミー サンプル рыба", r"beispiel-?text|blindtext|platzhalter-?text|^bitte (?:ersetzen|ausfüllen|ergänzen)|(?:hier|an dieser stelle) (?:\w+ ){0,2}(?:text|beschreibung|inhalt|titel) (?:einfügen|eingeben|eintragen|ergänzen|folgt)|hier steht (?:ihr|dein|der) |texto de (?:ejemplo|relleno|muestra|prueba)|(?:su|tu|el|escriba|inserte|añada) (?:\w+ ){0,3}(?:texto|descripción|título|contenido|nombre)(?: va)? aquí|seu texto aqui|texte (?:d.exemple|de remplissage|fictif)|(?:votre|insérez|ajoutez|saisissez|entrez) (?:\w+ ){0,3}(?:texte|description|titre|contenu|nom)? ?ici(?:\W|$)|örnek (?:metin|metni|yazı|içerik)|buraya (?:\w+ ){0,2}(?:açıklama|metin|içerik|başlık|yazı|gelecek|ekle|yaz)|(?:açıklama|metin|içerik|başlık)\w* buraya|текст-заполнитель|рыба-?текст|пример текста|(?:здесь|сюда) (?:будет|вставьте|введите|впишите)|(?:вставьте|введите) (?:\w+ ){0,2}(?:текст|описание|название)|ダミーテキスト|ここに(?:テキスト|説明|内容|タイトル)|サンプルテキスト|占位(?:符|文字|文本)|(?:在此|此处|在这里)(?:处)?(?:填写|输入|添加|插入)|示例文(?:本|字)"),
    _rule("placeholder", True, "lorem dolor consectetur", r"lorem ipsum (?:dolor|sit)|dolor sit amet|consectetur adipisci|^\W*lorem ipsum\W*$"),
    # phrases that also occur in ordinary prose
    _rule("error_page", False, "see snag problem issue error failure timeout", rf"^\W*nothing to see here{END}|^#\W+(?:\w+ ){{0,4}}(?:error|failure|timeout){END}|^\W*we(?: have|.ve)? (?:hit|ran into|run into|encountered) an? (?:\w+ )?(?:snag|problem|issue|error){END}|^\W*(?:an )?error (?:has )?occurred{END}"),
    _rule("error_page", False, "expired valid", rf"^\W*(?:your|this|the) (?:\w+ )?\w+ (?:has expired|is expired|expired|is no longer valid|has timed out|was not recogni[sz]ed){END}"),
    _rule("error_page", False, "again later back retry reload refresh if_this", rf"^(?:please )?(?:come back|try (?:it )?again|retry|check back|reload|refresh)(?: (?:the|this) page| again)?(?: (?:later|soon|shortly|in (?:a few|#) \w+|after # \w+))?{END}|^go back or search for |^if this (?:goes on|continues|keeps happening|problem persists),? "),
    _rule("error_page", False, "sign_in signed log_in logged login authenticat", rf"^(?:please |you (?:must|need to|have to) )?(?:be )?(?:sign|log|signed|logged) ?in (?:again |first )?(?:to (?:continue|go on|proceed|view|see|access) ?.*|to go on){END}|^(?:login|sign-?in|authentication) (?:is )?(?:required|failed|needed){END}|^you (?:must|need to|have to) be (?:logged|signed) in.*"),
    _rule("error_page", False, "cannot could unavailable refused lost reset", rf"^(?:the|this|your) \w+ (?:cannot|could not|can.t|couldn.t) be (?:shown|displayed|found|loaded|opened|reached){END}|^(?:the|this|your) \w+ is (?:currently |temporarily )?(?:unavailable|not available|offline){END}|^(?:the )?connection (?:was )?(?:refused|lost|reset|closed|failed){END}"),
    _rule("script_notice", False, "blocks them wait loading redirect moment", rf"^your browser blocks them{END}|^(?:please wait|just a moment|one moment(?: please)?|loading|redirecting|you are being redirected.*){END}"),
    # furniture of pages: neither residue nor content
    _rule("furniture", False, "home start sign_in log_in login docs status explore contact pricing explore search terms privacy support download community faq menu startseite anmelden hilfe kontakt inicio ayuda contacto accueil aide ana_sayfa giriş yardım главная вход помощь",
        r"^(?:(?:home|start|start ?page|sign in|sign up|sign out|log in|log out|login|logout|register|help|docs|documentation|status|explore|contact|contact us|pricing|projects|about|about us|blog|search|terms|privacy|features|support|download|downloads|community|faq|menu|products|careers|news|"
        r"startseite|anmelden|hilfe|kontakt|impressum|inicio|ayuda|contacto|accueil|aide|connexion|ana sayfa|giriş|yardım|iletişim|главная|вход|помощь|контакты)(?:\s*[|·•/>,-]\s*|\s+|$)){3,}$"),
    _rule("furniture", False, "try_again back zurück volver retour вернитесь dön loading this_takes incident reference code request ray trace support server_time oops sorry http error",
        r"^(?:try again|go back|back|back to (?:the )?(?:start|home|main) ?page|zurück zur startseite|volver al inicio|retour à l.accueil|вернитесь на главную|ana sayfaya dön\w*|loading|this takes a few (?:seconds|moments)|(?:incident|reference|code|error code|request id|ray|ray id|trace|trace id|support id|server time)\b\W*[\w#:@ -]*(?:utc)?|"
        r"oops|sorry|#|(?:http|error) ?#?|[\w.-]+/#)[\s.!…:;]*$"),
)
SPLIT = re.compile(r"\s(?:(?<=[.!?…]\s)\s*|\s*[-–—|·]+\s+)")
IDEOGRAPHIC = re.compile(r"(?<=[。！？])(?=\S)")
LEAD = re.compile(r"^\s*(?:[-*+]\s+(?!\[)|#{1,6}\s+|\d+\.\s+)?|\s+$")
MARKERS = frozenset(" \t-*+#0123456789")
BLOCKS = re.compile(r"(?i)</?(?:html|head|body|title|h[1-6]|p|div|center|hr|br|noscript|main|section|article|header|footer|li|ul|ol|td|tr|table)(?:\s[^<>]*)?/?>")
LATIN = re.compile(r"^(?:lorem|ipsu|ipso|dolo|dolu|amet|cons|adip|elit|frin|pulv|nisl|nisi|grav|magn|auct|ferr|vell|veli|vel|port|cura|nunc|morb|temp|soda|vera|libe|inte|sita|sit|sed|eius|inci|labo|mini|veni|quis|nost|exer|ulla|aliq|comm|duis|aute|irur|repr|volu|esse|cill|fugi|null|pari|exce|sint|occa|cupi|proi|sunt|culp|offi|dese|moll|anim|est|tinc|pell|habi|tris|sene|netu|male|fame|turp|eges|vest|loba|orna|susc|bibe|phas|ut|et|in|ac|at|non|ante|enim|arcu|diam|tort|faci|curs|sapi|matt|vita|quam|feli|eros|orci|pharetra|hend|vulp|cong|moles|semp|just|lacu|liga|maec|viverra|tell|urna|ultr|vari|vene)")
LATIN_END = re.compile(r"(?:um|us|is|it|at|or|am|em|er|a|id|in|ar|ies|ur|es|ec|os|ae|que|unt|ler|tis|lis|e)$")
KEYS = frozenset("foo bar baz qux quux corge asdf asdfg asdfgh asdfasdf qwer qwert qwerty zxcv hjkl jkl fdsa blah bla lala xyz xyzzy test testing aaa bbb ccc abc dummy".split())
WORDS = re.compile(r"[^\W\d_]+")
ITEM = re.compile(r"(?:[-*+]|\d+[.)])\s")
INLINE = re.compile(r"``[^\n]*?``|`[^`\n]*`")
QUOTE_SIGNS = re.compile("[\"“„«‘]|(?<!\\w)'")
QUOTED = re.compile(r"(?<!\w)[\"“„][^\"“”„\n]+[\"”“](?!\w)|«[^«»\n]+»(?=[\s.,;)])(?<=[^A-Z]»)|(?<!\w)[‘'][^‘’'\n]+[’'](?!\w)")
FORMULA = re.compile(r"\$[^$\n]*[\\_^{][^$\n]*\$")
SLOT_FORMULA = re.compile(r"\$\$?(?:\{?[\w .-]+\}?)\$?\$")
ADDRESS = re.compile(r"https?://\S+|\b[\w.+-]+@[\w-]+\.[\w.]+")
HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b")
NUMBER = re.compile(r"\d+(?:[.:/-]\d+)*")
FENCED = re.compile(r"(?ms)^ {0,3}(```|~~~).*?(?:^ {0,3}\1[^\n]*$|\Z)")
PARAGRAPH = re.compile(r"\n\s*\n")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    by_cue: dict[str, set[int]] = {}
    for i, r in enumerate(RULES):
        for c in r.cues.split():
            by_cue.setdefault(c.replace("_", " "), set()).add(i)
    for cue, rules in by_cue.items():
        a.add_word(cue, tuple(sorted(rules)))
    a.make_automaton()
    return a


def prose(text: str) -> str:
    """The text without code, quotations and quoted strings."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    full = [x for x in lines if x.strip()]
    if all(x.startswith(("    ", "\t")) for x in full):  # indented as a whole: nothing to stand out from
        lines = [x.strip() for x in lines]
    out: list[str] = []
    fence, blank, code, item = "", True, False, False
    for line in lines:
        s = line.strip()
        if fence:
            if s.startswith(fence) and not s.strip(fence[0]):
                fence = ""
            continue
        if s.startswith(("```", "~~~")) and len(line) - len(line.lstrip(" ")) < 4:
            fence = s[:3]
            out.append("")
            continue
        if line.startswith(("    ", "\t")) and s and not item and (blank or code):
            code = True
            continue
        code = code and not s
        blank = not s
        if s:
            item = bool(ITEM.match(s)) or (item and line[:1] in " \t")
        out.append("" if s.startswith(">") else line)
    t = "\n".join(out)
    if "`" in t:
        t = INLINE.sub(" ", t)
    if QUOTE_SIGNS.search(t):
        t = QUOTED.sub(" ", t)
    if "$" in t:
        t = FORMULA.sub(lambda m: m.group() if SLOT_FORMULA.fullmatch(m.group()) or m.group().startswith("${") else " ", t)
    return t


def normalised(message: str) -> str:
    """Lower case with addresses, dates, hex codes and numbers masked and blanks folded."""
    m = message.lower().replace("’", "'").replace("i̇", "i")
    if "@" in m or "://" in m:
        m = ADDRESS.sub("@", m)
    return " ".join(NUMBER.sub("#", HEX.sub("#", m)).split())


def _status(v: object) -> bool:
    return isinstance(v, (int, str)) and not isinstance(v, bool) and re.fullmatch(r"[345]\d\d", str(v).strip()) is not None


def error_body(line: str) -> bool:
    """Whether a line is the body of an error answer in JSON, XML or HTML."""
    s = line.strip()
    if s.startswith("{") and s.endswith("}"):
        try:
            o = json.loads(s)
        except (ValueError, RecursionError):
            return False
        inner = o.get("error", o.get("errors", o)) if isinstance(o, dict) else None
        if isinstance(inner, list):
            inner = inner[0] if inner else None
        if not isinstance(o, dict) or inner is None:
            return False
        both = {k.lower(): v for d in (o, inner) if isinstance(d, dict) for k, v in d.items()}
        said = {"message", "error", "errors", "detail", "title", "error_description", "reason"} & both.keys()
        if not said:
            return False
        return any(_status(both[k]) for k in ("status", "code", "statuscode", "status_code", "errorcode", "error") if k in both) or any(isinstance(both[k], str) and judged(both[k])[1] for k in said)
    if s.startswith("<"):
        return bool(re.match(r"(?i)(?:<\?xml[^>]*\?>\s*)?<(?:\w+:)?(?:error|errorresponse|fault)\b[^>]*>.*<(?:\w+:)?(?:code|message|faultcode|faultstring|status|reason)\b", s))
    return False


class _Words(dict):
    """What a word is to a filler sentence: 'key' | 'latin' | 'ending' (dummy Latin by beginning and end) | 'short' | 'plain' | '' (no word), remembered."""

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        m = WORDS.search(token.lower())
        w = m.group() if m else ""
        if w in KEYS or len(w) > 2 and len(set(w)) == 1:
            kind = "key"
        elif len(w) < 4:
            kind = "short" if w else ""
        elif LATIN.match(w):
            kind = "ending" if LATIN_END.search(w) else "latin"
        else:
            kind = "plain"
        self[token] = kind
        return kind


_words = _Words()


def filler(message: str) -> bool:
    """Whether a sentence is dummy Latin, keyboard runs or one word over and over."""
    tokens = message.split()
    if len(tokens) < 3 or not {_words[x] for x in tokens[:2]} & {"key", "ending"} and tokens[0].lower() != tokens[-1].lower().strip(".,;!?"):
        return False
    kinds = [k for k in (_words[x] for x in tokens) if k]
    n = len(kinds)
    if n >= 3 and len({x.lower().strip(".,;!?") for x in tokens}) == 1:
        return True
    m = n - kinds.count("short")
    return n >= 4 and (kinds.count("key") >= 0.8 * n or m >= 4 and kinds.count("ending") + kinds.count("latin") >= 0.8 * m and kinds.count("ending") >= 0.7 * m)


def cued(message: str) -> set[int]:
    """The rules of which a message holds a cue."""
    low = message.lower()
    if "  " in low:
        low = " ".join(low.split())
    return {i for _, rules in automaton().iter(low.replace("’", "'") if "’" in low else low) for i in rules}


def judged(message: str, hits: set[int] | None = None) -> tuple[str, bool, str]:
    """(kind, strong, masked form) of a message; kind is '' for none and 'furniture' for page furniture."""
    hits = cued(message) if hits is None else hits
    norm = weak = ""
    if hits:
        norm = normalised(message)
        talk = None
        for i in sorted(hits):
            r = RULES[i]
            if (not weak or r.strong) and r.pattern.search(norm):
                if r.kind == "furniture":
                    weak = weak or r.kind
                    continue
                talk = TALK.search(norm) is not None if talk is None else talk
                if talk:
                    break
                if r.strong:
                    return r.kind, True, norm
                weak = r.kind
    if not weak and filler(message):
        return "placeholder", True, norm or normalised(message)
    return weak, False, norm


def placeholder(line: str) -> bool:
    """Whether a line has a slot that nobody filled, or a fill gone wrong."""
    return any(sign in line and p.search(line) for sign, p in PLACEHOLDERS) or (line.count("|") == 2 and bool(BARRED.search(line)))


def parts_of(line: str) -> list[str]:
    """The sentences of a line, cut also at dashes and bars that stand alone."""
    if "。" in line or "！" in line or "？" in line:
        line = IDEOGRAPHIC.sub(" ", line).replace("。 ", "。\n ").replace("！ ", "！\n ").replace("？ ", "？\n ")
        return [z for x in line.split("\n") for y in SPLIT.split(x) if (z := y.lstrip("-–—|· "))]
    return [z for x in SPLIT.split(line) if (z := x.lstrip("-–—|· "))]


def found_in(text: str) -> list[tuple[str, str, bool, bool]]:
    """(masked message, kind, sure, on a line of its own) of the residue messages of a text."""
    out: dict[tuple[str, str], tuple[bool, bool]] = {}
    weak: list[tuple[int, str, str, bool]] = []
    content = furniture = False

    def keep(norm: str, kind: str, sure: bool, own: bool) -> None:
        a, b = out.get((norm, kind), (False, False))
        out[norm, kind] = (a or sure, b or own)

    t = prose(text)
    if "{\"" in text or "<" in text:  # bodies hold quotes, so they are looked for in the text as it stands
        for line in FENCED.sub("", text).split("\n"):
            if line[:1] in "{<" and error_body(line):
                keep(normalised(line), "error_page", True, True)
                t = t.replace(line, "")
    if "<" in t:
        t = BLOCKS.sub("\n", t)
    for p, paragraph in enumerate(PARAGRAPH.split(t)):
        for line in paragraph.split("\n"):
            line = LEAD.sub("", line) if line[:1] in MARKERS else line.rstrip()
            if not line:
                continue
            if placeholder(line):
                keep(normalised(line), "placeholder", True, True)
                continue
            hits = cued(line)
            parts = parts_of(line)
            if hits and len(parts) > 1:
                kind, strong, norm = judged(line, hits)
                if strong:
                    keep(norm, kind, True, True)
                    continue
                if kind == "furniture":
                    furniture = True
                    continue
            for x in parts:
                kind, strong, norm = judged(x, hits if len(parts) == 1 else None) if hits else ("placeholder" if filler(x) else "", True, "")
                if kind == "furniture":
                    furniture = furniture or len(norm) > 1
                elif kind and strong:
                    keep(norm or normalised(x), kind, True, len(parts) == 1)
                elif kind:
                    weak.append((p, norm, kind, len(parts) == 1))
                elif not content and WORDS.search(x):
                    content = True
    for p, norm, kind, own in weak:
        beside = any(q == p and n != norm for q, n, _, _ in weak) or any(sure for sure, _ in out.values())
        keep(norm, kind, not content or furniture or beside, own)
    return [(norm, kind, sure, own) for (norm, kind), (sure, own) in out.items()]


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(d, s, *r) for d, s, t in zip(pdf["doc_id"], pdf["source"], pdf["t_"]) for r in found_in(t)]
        yield pd.DataFrame(rows, columns=["doc_id", "source", "norm", "kind", "sure", "own"])


def messages(documents: DataFrame) -> DataFrame:
    """(doc_id, source, norm, kind, sure, own) of every residue message, in one pass over whole texts without shuffle."""
    given = documents.select("doc_id", "source", F.col("text").alias("t_")).where("t_ is not null and trim(t_) <> ''")
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInPandas(_found, f"doc_id {kind}, source string, norm string, kind string, sure boolean, own boolean")


def residue_lines(found: DataFrame) -> DataFrame:
    """(doc_id, source, norm, kind) of the messages that are residue: sure ones, and lines whose masked form recurs widely."""
    h = found.withColumn("h", F.xxhash64("norm"))
    # distinct (hash, document, source) first, so a message in a third of all documents is counted in parts
    recurs = (
        h.where("own and not sure").select("h", "doc_id", "source").distinct()
        .groupBy("h").agg(F.count_distinct(F.struct("doc_id")).alias("documents"), F.count_distinct(F.struct("source")).alias("sources"))
        .where((F.col("documents") >= RECUR_DOCUMENTS) & (F.col("sources") >= RECUR_SOURCES)).select("h")
    )
    return h.where("sure").unionByName(h.where("own and not sure").join(recurs, "h", "left_semi")).select("doc_id", "source", "norm", "kind")


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kind) of documents with residue, the least kind by name where several apply."""
    found = cut(messages(documents))  # a small part of the texts; they are read once
    return residue_lines(found).groupBy("doc_id").agg(F.min("kind").alias("kind"))


def recurrence(documents: DataFrame) -> DataFrame:
    """(kind, norm, documents, sources) of every masked residue message: the distinct documents and sources it is residue in."""
    each = residue_lines(cut(messages(documents))).select("kind", "norm", "doc_id", "source").distinct()
    return each.groupBy("kind", "norm").agg(F.count_distinct(F.struct("doc_id")).alias("documents"), F.count_distinct(F.struct("source")).alias("sources"))
