"""Labelled lines of three kinds, put together by rule, and word weights fitted on them.

``site`` lines are what web sites put around articles (menus, notices, prompts, imprints), ``message``
lines stand in place of an article (errors, refusals, demands to allow scripts), ``prose`` lines are
article sentences. They are combined from short parts in English, German and Chinese, so that the
weights learn words and not sentences.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache
from itertools import product

_TOKEN = re.compile(r"[一-鿿]|[^\W\d_一-鿿]{2,}|©|[|·»>]")

#: Names of faults, as in KeyError.
_FAULT = re.compile(r"\b\w+(?:Error|Exception|Fault)\b")


def tokens(text: str) -> list[str]:
    """Words in lower case; Chinese as pairs of neighbouring characters."""
    found = _TOKEN.findall(_FAULT.sub("error", text).lower())
    if text.isascii():
        return found
    out = [t for t in found if not "一" <= t <= "鿿"]
    return out + [a + b for a, b in zip(found, found[1:]) if "一" <= a <= "鿿" and "一" <= b <= "鿿"]


def _crossed(*parts: str) -> list[str]:
    """All combinations of the alternatives (split at |) of each part."""
    return ["".join(x).strip() for x in product(*(p.split("|") for p in parts))]


def messages() -> list[str]:
    """Lines that stand in place of an article."""
    thing = "The page|This page|That page|The file|This site|The website|The server|Our service|Your account|This account|The link|The address|The document|This content|The article|The resource|Your session|The connection|Your request|The database|This application"
    state = (
        " could not be found| can't be found| was not found| does not exist| no longer exists| is not available| is temporarily unavailable| is currently unavailable| has been removed| was deleted| has been moved| has been suspended| has been disabled| is blocked|"
        " is down for maintenance| is offline| is overloaded| is not responding| did not respond| timed out| has expired| failed to load| could not be loaded| was refused| was denied| is restricted| is forbidden| has crashed| is private| requires a login| requires JavaScript| needs scripts to run| cannot be shown without JavaScript"
    )
    ask = "Enable JavaScript|Turn on scripts in your browser|Switch on scripting|Allow scripts|Activate cookies|Reload|Refresh|Try again later|Try again in a few minutes|Log in|Sign in|Come back later|Check the address|Contact support|Contact the administrator|Complete the captcha|Verify that you are human|Prove you are not a robot|Wait a moment|Disable your ad blocker|Update your browser|Use another browser"
    bare = (
        "404 Not Found|403 Forbidden|401 Unauthorized|400 Bad Request|500 Internal Server Error|502 Bad Gateway|503 Service Unavailable|504 Gateway Timeout|Error 1020|Access denied|Permission denied|Page not found|File not found|Too many requests|Rate limit exceeded|Slow down|Request blocked|Internal error|"
        "Fatal error|Syntax error|Unhandled exception|Database error|Traceback (most recent call last)|Connection refused|Connection reset|Sorry|Oops|Uh oh|Whoops|Something went wrong|It seems something went wrong|Something broke on our end|An error occurred|An unexpected error has occurred|Loading|If nothing happens, click here|Please wait|Just a moment|One moment please|Checking your browser|"
        "Redirecting|Under construction|Back soon|We will be right back|We will be back soon|Scheduled maintenance|JavaScript is disabled|JavaScript is required|JavaScript is not available|JavaScript must be enabled|You need to enable JavaScript|Scripts are turned off|Your browser does not support JavaScript|Your browser is not supported|You do not have permission|You are not allowed to view this|You lack the rights for this page|"
        "You have been blocked|Unusual traffic from your network|Session expired|Nothing was found here|Nothing to see at this address|Gone|No such page|Unknown action|Invalid request|KeyError in line 3|Traceback: ValueError|TypeError: undefined is not a function|Uncaught exception in module|Nothing exists at this address|There is nothing here any more|No content at this address|Code 7|We can't find what you are looking for|We could not process your request|We cannot load this right now|Invalid reply from upstream|Host cannot be reached|There is currently no text in this page|Search for this title in other pages|Error code|Reference number|Request id|Cloud gateway error"
    )
    dinge = "Die Seite|Diese Seite|Die Datei|Diese Website|Die Adresse|Der Server|Der Dienst|Der Beitrag|Dieser Artikel|Dieser Inhalt|Ihr Konto|Ihre Sitzung|Die Anfrage|Die Verbindung|Die Anwendung"
    zustand = " wurde nicht gefunden| konnte nicht gefunden werden| existiert nicht| ist nicht verfügbar| ist derzeit nicht erreichbar| antwortet nicht| wurde gelöscht| wurde entfernt| wurde gesperrt| ist abgelaufen| wird gewartet| ist überlastet| konnte nicht geladen werden| benötigt JavaScript| erfordert Skripte| wurde abgelehnt"
    bitte = "JavaScript aktivieren|Skripte erlauben|Cookies zulassen|Später erneut versuchen|Kurz warten|Bitte warten|Bitte anmelden|Browser aktualisieren|Einstellungen prüfen|Seite neu laden|Bitte die Sicherheitsprüfung abschließen"
    kurz = "Zugriff verweigert|Kein Zugriff|Ihnen fehlt die Berechtigung|Sie haben keine Rechte|Fehler|Interner Fehler|Da ist etwas schiefgelaufen|Ein Fehler ist aufgetreten|Hoppla|Zu viele Anfragen|Zu viele Zugriffe|Zeitüberschreitung|Wartungsarbeiten|Wir sind bald wieder da|Wir sind gleich zurück|Wird geladen|Ohne Skripte geht es hier nicht|JavaScript ist deaktiviert|Nicht gefunden|Verboten|Fehlercode|Kennung"
    zh = (
        _crossed("您|你", "访问的|查找的|请求的|要找的", "页面|网页|内容|文件", "不存在|未找到|找不到了|已删除|走丢了")
        + _crossed("该|此|本", "页面|内容|网站|账号|条目|文章", "已被删除|已被移除|已被封禁|已下架|暂时无法访问|不可用|需要启用脚本|需要允许运行脚本")
        + _crossed("请", "启用|开启|允许", "脚本|JavaScript|Cookie", "后继续|才能继续浏览|再刷新页面|")
        + "服务器出错|服务器繁忙|服务器开小差了|服务器内部错误|服务器无响应|系统维护中|网站维护|预计稍后恢复|请稍后再试|请稍后重试|请稍候|正在加载|加载中|加载失败|访问被拒绝|访问受限|拒绝访问|没有权限|您没有访问权限|请求过于频繁|请完成安全验证|请先登录|正在验证您的浏览器|您的浏览器不支持|您的浏览器已禁用脚本|页面不存在|页面未找到|网关超时|网关错误|请求超时|出错了|抱歉|对不起|错误代码|错误编号|编号".split("|")
    )
    out = _crossed(thing, state) + _crossed("|Please ", ask, "| to continue| to view this page| for this site| and reload") + bare.split("|") * 4
    return out + _crossed(dinge, zustand) + _crossed("Bitte |", bitte, "|, um fortzufahren") + kurz.split("|") * 3 + zh * 2


def site_lines() -> list[str]:
    """Lines that a site puts around its articles."""
    out = (
        _crossed("Share|Like|Bookmark", " this page| this article| this post", " on social media| on Facebook| with your friends| by e-mail|")
        + _crossed("Follow|Find", " us on", " Twitter| Instagram| YouTube| our official channel")
        + _crossed("Subscribe to|Sign up for|Join", " our| the", " newsletter| weekly newsletter| mailing list| updates| free mail")
        + _crossed("Cookie notice|We use cookies|This site uses cookies|Accept cookies", "| to improve your visit| to show ads", "| accept| OK| settings")
        + _crossed("© |Copyright |(c) ", "2020 |2024 |", "All rights reserved|All names and trademarks belong to their owners|Content is licensed under the terms unless noted otherwise|Text is available under a free license")
        + _crossed("Last edited|Last updated|Last modified|Page changed", " on May 3| 2 days ago| yesterday", " by staff| by an anonymous user|", "| (120 views)")
        + _crossed("Written by|Posted by|Edited by|Published by", " the editorial team| our staff| the desk| admin", "| on June 2| 2021-04-03")
        + _crossed("Print|Printable", " version| this page| page view", "| | PDF")
        + _crossed("Privacy policy|Terms of use|Imprint|Contact|About us|Help|Site map|Disclaimer", " | · | » ", "Home|Contact|About|Login|Register|Jobs|Press")
        + _crossed("Home | |Start | ", "News | |Blog | |", "About | |Forum | ", "Contact|Login|Search")
        + _crossed("Rate this|Did you like this|Was this helpful", " page?| article?", "| (12 votes)| Yes No")
        + _crossed("Report|Found", " an error| a mistake| a problem", "?| on this page| to the team")
        + _crossed("This article is", " a stub| incomplete| out of date", "; you can help by expanding it| and needs your help")
        + _crossed("Leave a|Post a|Write a", " comment| reply| review", "| below")
        + "Skip to content|Back to top|Advertisement|Sponsored content|Related articles|Read more|You may also like|Menu|Search|Log in|Sign up|Register|Recent changes|Random page|Main page|Navigation|Table of contents|Download our app|Retrieved from the archive|You are reading the print edition|Join our community|Thanks for reading|Read next".split("|")
        + _crossed("Seite|Artikel|Beitrag", " teilen| drucken| weiterempfehlen| bewerten", "| mit Freunden| auf Facebook")
        + _crossed("Newsletter|Unseren Newsletter|Den wöchentlichen Newsletter", " abonnieren| bestellen| lesen und nichts verpassen")
        + _crossed("© 2022 |", "Alle Rechte vorbehalten|Alle Marken und Namen gehören ihren Inhabern|Der Text steht unter einer freien Lizenz|Es gelten die Nutzungsbedingungen")
        + _crossed("Zuletzt|Letzte Änderung:", " bearbeitet| geändert| aktualisiert", " vor 3 Tagen| gestern", "| (90 Aufrufe)| von der Redaktion")
        + _crossed("Verfasst|Geschrieben|Veröffentlicht", " von", " der Redaktion| unserem Team", " am 3. Mai|")
        + "Startseite|Impressum|Datenschutz|Datenschutz und Cookies|Nutzungsbedingungen|Kontakt|Über uns|Anmelden|Registrieren|Nach oben|Anzeige|Werbung|Mehr dazu|Kommentar schreiben|Wir verwenden Cookies|Cookies akzeptieren|Fehler auf der Seite melden|Schreib unserem Team|Druckversion|Hilf mit, diesen Artikel zu erweitern|Folge uns|Danke fürs Lesen|Abgerufen aus dem Archiv".split("|")
        + _crossed("分享|收藏|打印|举报", "本页|本文|此文章", "|给朋友|到微博")
        + _crossed("版权所有|© 2023 版权归原作者所有", "|，转载请注明出处|，未经许可不得转载")
        + _crossed("最后|最近", "编辑于|更新于", "昨天|3天前", "|，浏览100次|，由编辑部发布")
        + "关注我们|关注官方账号，获取最新资讯|订阅邮件|扫码下载客户端|欢迎投稿|隐私政策|使用条款|联系我们|关于我们|网站首页|登录|注册|返回顶部|广告|相关阅读|阅读全文|我们使用Cookie|接受Cookie|如有错误请联系编辑|发现错误请告诉我们|本文由编辑部整理|本条目是小作品，欢迎帮助扩充|感谢阅读|打印版本|查看更多攻略|发表评论|喜欢这篇文章吗".split("|")
    )
    return [x for x in out if x]


_EN = (
    "the miller|a king|her horse|the old guard|this sword|the northern gate|every player|a small village|the dragon|our hero|the blue potion|his brother|the second boss|an empty room|the harvest|a wooden bridge|the council|an early map|the river|the merchant|there is an owl that|there are wolves and nobody|the mod|the editor before it",
    " carries| protects| opens| needs| finds| was built near| grows beside| never leaves| gives| weakens| sells| learned from| depends on| can load| need| attacks| remembers| increases| is made of| looks like",
    " a heavy shield| three coins| the eastern road| more damage than before| some water| the winter camp| stone and iron| a quiet song| the lost crown| enough food for a week| an enemy at night| its own tail| two letters| the page in the library| a key| an inn on the hill| it in the rain| something at home| an old text| its content| a list of names| JavaScript in the editor| to be enabled before the load",
)
_DE = (
    "der Müller|die Königin|das alte Tor|ein Händler|die Wache|jeder Spieler|das Dorf|der Drache|ihr Bruder|die Brücke|ein Ritter|der zweite Gegner|es gibt hier|wer sieht|danach",
    " trägt| schützt| öffnet| braucht| findet| steht neben| verlässt nie| kauft| stärkt| erinnert an| liegt hinter| lernt von",
    " ein schweres Schild| drei Münzen| die Straße im Osten| etwas Wasser| das Lager im Winter| Stein und Eisen| ein leises Lied| genug Brot auf dem Dach| den Feind bei Nacht| zwei Briefe| ein Haus unter der Brücke| es im Garten| sich vor dem Sturm",
)
_ZH = ("国王|商人|老守卫|英雄|村子|巨龙|玩家|小河|骑士|桥", "保护|打开|需要|发现|带着|学会|卖掉|靠近|想起|离开|找到|看见|这里有", "三枚金币|旧地图|北边的路|一把钥匙|很多食物|冬天的营地|失落的王冠|木头和石头|夜里的敌人|一首歌|编辑器里的模组|需要启用JavaScript的编辑器|才能加载的模组")


def prose() -> list[str]:
    """Article sentences."""
    r = random.Random(11)
    out = []
    for parts in (_EN, _EN, _DE):
        mid = (" and ", " while ", " because ", ", so ", ". ") if parts is _EN else (" und ", ", weil ", ", doch ", ". ")
        for s in r.sample(_crossed(*parts), 500):
            out.append(s[0].upper() + s[1:] + r.choice((".", r.choice(mid) + r.choice(parts[0].split("|")) + r.choice(parts[1].split("|")) + r.choice(parts[2].split("|")) + ".")))
    return out + [x + "。" for x in r.sample(_crossed(*_ZH), 400)]


LINES = {"message": messages, "site": site_lines, "prose": prose}
#: What a word that no labelled line holds speaks for prose.
UNKNOWN = -0.4


@lru_cache(maxsize=8)
def weights(kind: str, half: int | None = None) -> dict[str, float]:
    """The log odds of each word in lines of ``kind`` against prose; ``half`` takes every second line only."""
    here, there = (Counter(t for k, line in enumerate(LINES[x]()) if half is None or k % 2 == half for t in tokens(line)) for x in (kind, "prose"))
    size = len(here | there)
    a, b = sum(here.values()) + 0.5 * size, sum(there.values()) + 0.5 * size
    return {t: max(-4.0, min(4.0, math.log((here[t] + 0.5) / a) - math.log((there[t] + 0.5) / b))) for t in here | there}


def leaning(text: str, weight: dict[str, float]) -> float:
    """The mean log odds of a text's words, drawn towards 0 where they are few."""
    found, get = tokens(text), weight.get
    return sum([get(t, UNKNOWN) for t in found]) / (len(found) + 3)
