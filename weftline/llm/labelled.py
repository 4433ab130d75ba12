"""Labelled pages to train the page model: written here by rule, with every line's label known by construction.

A page is a list of blocks (menu, path, headline, byline, paragraphs, lists, notices, comments, related links, letters, legal lines) of one of
four languages, laid out as HTML or as text in several ways. The words of the body are made up from syllables, so that the model
can only learn from form, place and the curated phrases.
"""

from __future__ import annotations

import random

import numpy as np

from weftline.llm import furniture as fu
from weftline.llm.pages import Trees, add_page

N_PAGES = 1500
SEED = 20

_FUNCTION = {
    "en": "the a of and to in with for it was is that by on as from".split(),
    "de": "der die das und mit in den von ist war für nicht ein auf dem".split(),
    "fr": "le la les et de des un une dans pour est avec sur que".split(),
    "es": "el la los y de en un una con por para es que del se".split(),
}
_SYLLABLES = "ba ko ri men tal so der vi na pel gru sha lo mi ter ce du fa no rel si ga tor".split()
_LINES = {
    "en": {
        "legal": ["Copyright © {y} {S} Ltd", "© {y} {S} and its authors, all rights reserved", "Terms and conditions | Privacy policy | Cookies", "{S} Ltd is registered in {P}, company number {n}{n}", "{S} is not liable for what other sites say.", "Nothing on this site may be copied or reproduced without permission from {S}. Figures are given without guarantee and can be out of date. Copyright {S}, all rights reserved.", "Disclaimer: {S} is not responsible for offers of third parties."],
        "consent": ["This site uses cookies.", "We use cookies and similar tools so that {S} runs well and to see how it is used. Choose accept all, or manage preferences to give your consent to some of them only.", "{S} and {n} of our partners would like your consent to store data on your device. You can change your privacy settings at any time at the foot of the page.", "Accept all | Reject all | Manage preferences", "If you go on reading, cookies will be set.", "Your privacy choices: some cookies are necessary, others help us to learn what is read. Personal data is handled as our policy says, and consent can be taken back.", "About your data: {S} asks for your consent before it reads or writes information on your device."],
        "share": ["Share on: a | b | c", "Tweet | Print this | Copy link", "Share this with others", "E-mail this to a friend or share on your page", "Follow us", "Did you like it? Share with friends"],
        "byline": ["By our {P} correspondent", "{P} {W}, staff writer", "By {P} {W}", "Posted by {P} on {n} May {y}", "Updated on {n} March {y}, {n} minute read", "By the editors | {n} min read", "{P} desk, {n} June", "Edited by {P} {W} for {S}"],
        "letter": ["Sign up for our newsletter", "Your email address: subscribe, and unsubscribe when you wish", "{S} in your inbox every week. No spam, we promise.", "Become a member of {S} and read all of it", "Our letter every morning, free for members of {S}"],
        "comments": ["Comments ({n})", "Post a comment", "Join the conversation", "{n} comments so far", "Leave a comment below"],
        "related": ["Related stories", "You might also like", "Most popular", "Trending on {S}", "More from {S}", "Recommended for you", "Latest posts", "Up next", "See also on {S}", "Editor's picks"],
        "path": ["You are here: {m} / {m} / {T}", "You are here: {m} > {T}"],
        "notice": ["Advertising", "Article continues below", "Clarification: a name was wrong in an earlier version.", "Editors' note: this text has been updated.", "Sponsored", "Read all of this in our app", "Part of a series on {W}", "Promoted"],
        "scripts": ["JavaScript is off in your browser; this site needs scripts.", "Please allow scripts for this site.", "This part of the page can't be shown without JavaScript."],
    },
    "de": {
        "legal": ["Copyright © {y} {S} GmbH", "Impressum | Datenschutz | Nutzungsbedingungen", "Nachdruck nur mit Erlaubnis von {S}. Rechte vorbehalten.", "{S} übernimmt keine Haftung für fremde Seiten."],
        "consent": ["Diese Seite setzt Cookies.", "Mit Ihrer Einwilligung lesen {S} und Partner Daten auf Ihrem Gerät, auch durch Cookies. Ihre Zustimmung gilt, bis Sie sie zurücknehmen; mehr steht unter Datenschutz.", "Alle akzeptieren | Nur nötige Cookies", "Ihre Privatsphäre ist {S} nicht egal: ohne Einwilligung wird nichts gezählt."],
        "share": ["Teilen | Drucken | Weitersagen", "Beitrag teilen", "Diese Seite an Freunde schicken"],
        "byline": ["Aus unserer Redaktion in {P}", "{P} {W}, veröffentlicht am {n}. Mai {y}", "Von {P} {W}, Lesezeit {n} Minuten", "Redaktion {P}, aktualisiert am {n}. Juni"],
        "letter": ["Unser Newsletter: jetzt abonnieren", "Jeden Morgen das Neueste von {S} an Ihre E-Mail", "Mitglied werden bei {S}"],
        "comments": ["Kommentare ({n})", "Kommentar schreiben", "Mitreden und antworten"],
        "related": ["Am beliebtesten", "Mehr von {S}", "Weitere Artikel", "Verwandte Themen", "Lesen Sie auch bei {S}"],
        "path": ["Sie sind hier: {m} / {m} / {T}"],
        "notice": ["Werbung", "Gesponsert", "Korrektur: ein Name war falsch.", "Anm. d. Red.: Angaben berichtigt.", "Nach der Anzeige geht es weiter"],
        "scripts": ["Bitte schalten Sie JavaScript ein.", "Ohne Skripten geht es hier nicht weiter."],
    },
    "fr": {
        "legal": ["Copyright © {y} {S} SA", "Mentions légales | Conditions d'utilisation", "Droits réservés à {S}. Toute reproduction se demande par écrit."],
        "consent": ["Ce site dépose des cookies.", "Avec votre consentement, {S} et ses partenaires lisent vos données sur cet appareil, entre autres par des cookies. Vous pouvez changer d'avis au bas de la page.", "Tout accepter | Tout refuser", "{S} tient à votre vie privée : sans consentement, rien n'est compté."],
        "share": ["Partager | Imprimer", "Partager cet article", "Envoyer à un proche"],
        "byline": ["De notre rédaction de {P}", "{P} {W}, publié le {n} mai {y}", "Par {P} {W}, {n} min de lecture", "Mis à jour le {n} juin"],
        "letter": ["Notre newsletter : s'abonner", "{S} chaque matin dans votre e-mail"],
        "comments": ["Commentaires ({n})", "Laisser un commentaire", "Répondre"],
        "related": ["Lire aussi", "Articles liés", "Les plus lus de {S}", "Sur le même sujet"],
        "path": ["Vous êtes ici : {m} / {m} / {T}"],
        "notice": ["Sponsorisé", "Rectificatif : un nom était faux.", "La suite après cette publicité", "Note de la rédaction : chiffres revus."],
        "scripts": ["Veuillez activer JavaScript.", "Sans les scripts, rien ne s'affiche."],
    },
    "es": {
        "legal": ["Copyright © {y} {S} SA", "Aviso legal | Condiciones de uso", "Derechos reservados a {S}. {S} no se hace responsable de otros sitios."],
        "consent": ["Este sitio instala cookies.", "Con su consentimiento, {S} y sus socios leen sus datos en este aparato, también con cookies. Puede cambiar de idea al pie de la página.", "Aceptar todo | Rechazar todo", "A {S} le importa su privacidad: sin consentimiento no se cuenta nada."],
        "share": ["Compartir | Imprimir", "Compartir este artículo", "Enviar a alguien"],
        "byline": ["De nuestra redacción en {P}", "{P} {W}, publicado el {n} de mayo de {y}", "Por {P} {W}, {n} min de lectura", "Actualizado el {n} de junio"],
        "letter": ["Nuestra newsletter: suscribirse", "{S} cada mañana en su correo"],
        "comments": ["Comentarios ({n})", "Comentar", "Responder a esto"],
        "related": ["Lea también", "Artículos relacionados", "Lo más leído de {S}", "Más de {S}", "También le puede interesar"],
        "path": ["Usted está aquí: {m} / {m} / {T}", "Está aquí: {m} > {T}"],
        "notice": ["Patrocinado", "Corrección: un nombre estaba mal.", "Continúa tras la publicidad", "Nota de la redacción: cifras revisadas."],
        "scripts": ["Por favor, active JavaScript.", "Sin scripts activados no se ve nada."],
    },
}
_STUBS = ["Error 404", "Page not found", "Access denied", "502 Bad Gateway", "Please try again later.", "Hello {{name}}, welcome to {{site}}.", "${title}", "Lorem ipsum dolor sit amet consectetur.", "One moment while we check your browser", "Loading..."]


class _Writer:
    def __init__(self, rng: random.Random):
        self.r, self.lang = rng, rng.choices(["en", "de", "fr", "es"], [5, 2, 2, 2])[0]
        self.site = self.word().capitalize() + "works"
        of_language = fu.PHRASES["menu"].strip("\n").split("\n")[["en", "de", "fr", "es"].index(self.lang)]
        self.menu_words = [w.strip().capitalize() for w in of_language.split("|")]

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 3)))

    def words(self, n: int) -> str:
        return " ".join(self.r.choice(_FUNCTION[self.lang]) if self.r.random() < 0.45 else self.word() for _ in range(n))

    def sentence(self) -> str:
        s = self.words(self.r.randint(5, 18)).capitalize()
        if self.r.random() < 0.25:
            s = s.replace(" ", ", ", 1)
        if self.r.random() < 0.12:
            a = s.split(" ")
            k = self.r.randrange(len(a))
            a[k] = f"{self.r.randint(2, 90000)}"
            s = " ".join(a)
        if self.r.random() < 0.1:
            s = f"{self.r.choice('ABCDEFGH')}. {self.word().capitalize()} " + s.lower()
        if self.r.random() < 0.07:  # body text also speaks of such things
            kind = self.r.choice(["scripts", "consent", "letter", "comments", "notice", "legal", "share"])
            s = f"{s} {self.r.choice(fu.phrases(kind))} {self.words(4)}"
        if self.r.random() < 0.06:
            s = f"{self.words(3).capitalize()}: {s.lower()}"
        return s + self.r.choices([".", "?", "!"], [12, 1, 1])[0]

    def title(self) -> str:
        s = self.words(self.r.randint(2, 7)).capitalize()
        k = self.r.random()
        if k < 0.15:
            return s + "?"
        if k < 0.3:
            return f"{s}: {self.words(self.r.randint(2, 3))}"
        if k < 0.36:
            return f"{self.r.randint(2, 90)} {s.lower()}"
        if k < 0.42:
            return f"{self.words(self.r.randint(1, 2)).capitalize()}: {self.r.randint(2, 90)} {self.word()}"
        if k < 0.46:
            return f"{s}, {self.words(self.r.randint(2, 4))}"
        return s

    def line(self, kind: str, title: str = "") -> str:
        s = self.r.choice(_LINES[self.lang][kind])
        for a, b in (("{S}", self.site), ("{P}", self.word().capitalize()), ("{W}", self.word().capitalize()), ("{n}", str(self.r.randint(1, 400))), ("{y}", str(self.r.randint(1998, 2026))), ("{T}", title)):
            s = s.replace(a, b)
        while "{m}" in s:
            s = s.replace("{m}", self.r.choice(self.menu_words), 1)
        return s.upper() if self.r.random() < 0.03 else s

    def link(self, text: str) -> str:
        return f"[{text}](/{'-'.join(text.lower().split())})"


Block = tuple[str, list[str], int]


def _blocks(w: _Writer) -> tuple[list[Block], str]:
    r = w.r
    title = w.title()
    out: list[Block] = []
    menu = r.sample(w.menu_words, r.randint(3, 8))
    tops: list[Block] = []
    if r.random() < 0.6:
        tops.append(("menu", menu, 0))
    if r.random() < 0.4:
        tops.append(("path", [w.line("path", title)], 0))
    if r.random() < 0.4:
        tops.append(("consent", [w.line("consent") for _ in range(r.randint(1, 2))], 0))
    if r.random() < 0.2:
        tops.append(("related", [w.line("related")] + [w.title() for _ in range(r.randint(2, 5))], 0))
    out += tops
    stub = r.random() < 0.08
    if stub:
        out.append(("p", [r.choice(_STUBS)], 1))
        if r.random() < 0.5:
            out.append(("p", [r.choice(_STUBS)], 1))
    else:
        body: list[Block] = []
        if r.random() < 0.85:
            body.append(("headline", [title], 1))
        if r.random() < 0.6:
            body.insert(r.randint(0, len(body)), ("byline", [w.line("byline")], 0))
        for _ in range(r.choice([1, 1, 2, 3, 4, 6])):
            k = r.random()
            if k < 0.6:
                body.append(("p", [" ".join(w.sentence() for _ in range(r.choice([1, 1, 2, 3, 5])))], 1))
            elif k < 0.7:
                body.append(("list", [r.choice([w.title, w.sentence])() for _ in range(r.randint(2, 5))], 1))
            elif k < 0.78:
                body.append(("quote", [w.sentence() for _ in range(r.choice([1, 2]))], 1))
            elif k < 0.84:
                body.append(("table", [f"{w.title()}|{r.randint(2, 9999)}|{w.word().capitalize()}" for _ in range(r.randint(2, 4))], 1))
            elif k < 0.88:
                body.append(("code", [f"$ {w.word()} --{w.word()}={r.randint(1, 99)}", f"{w.word()}: {r.randint(1, 99)} ok"], 1))
            elif k < 0.96:
                body.append(("sub", [w.title()], 1))
                body.append(("p", [" ".join(w.sentence() for _ in range(r.choice([1, 2, 3])))], 1))
            if r.random() < 0.22:
                kind = r.choice(["notice", "notice", "share", "letter"])
                body.append((kind, [w.line(kind)], 0))
        out += body
    ends: list[Block] = []
    if r.random() < 0.35:
        ends.append(("comments", [w.line("comments")] + [f"{r.choice('ABCDEFG')}. {w.word().capitalize()}: {w.sentence()}" for _ in range(r.randint(1, 4))], 0))
    for _ in range(r.choice([0, 1, 1, 2])):
        ends.append(("related", [w.line("related")] + [w.title() for _ in range(r.randint(2, 5))], 0))
    if r.random() < 0.3:
        ends.append(("letter", [w.line("letter")], 0))
    if r.random() < 0.3:
        ends.append(("consent", [w.line("consent") for _ in range(r.randint(1, 2))], 0))
    r.shuffle(ends)
    if r.random() < 0.75:
        ends.append(("legal", [w.line("legal") for _ in range(r.randint(1, 4))], 0))
    if r.random() < 0.15 and not stub:
        ends.append(("scripts", [w.line("scripts")], 0))
    return out + ends, title


def _as_text(w: _Writer, blocks: list[Block]) -> tuple[str, list[int]]:
    r = w.r
    lines: list[tuple[str, int]] = []
    menu_style, related_style, marks = r.randrange(4), r.randrange(3), r.choice("**••11-")
    heads = r.random() < 0.75
    glued = r.choice([0.05, 0.3, 0.5])
    for kind, items, label in blocks:
        shown = list(items)
        if kind == "menu":
            shown = [" | ".join(items)] if menu_style == 0 else [" · ".join(items)] if menu_style == 1 else [w.link(x) for x in items] if menu_style == 2 else [r.choice(["- ", ""]) + x for x in items]
        elif kind == "headline":
            shown = [r.choice(["# ", "## "]) + items[0]] if heads else items
        elif kind == "sub":
            shown = ["## " + items[0]]
        elif kind == "list":
            shown = [(f"{i + 1}. " if marks == "1" else marks + " ") + x for i, x in enumerate(items)]
        elif kind == "quote":
            shown = ["> " + x for x in items]
        elif kind == "table":
            rows = ["| " + x.replace("|", " | ") + " |" for x in items]
            shown = [rows[0], "| --- | --- | --- |", *rows[1:]]
        elif kind == "code":
            shown = ["```", *items, "```"]
        elif kind == "related":
            rest = [f"- {w.link(x)}" if related_style == 0 else f"- {x}" if related_style == 1 else x for x in items[1:]]
            shown = [items[0], *([""] if r.random() < 0.7 else []), *rest]
        elif kind == "comments":
            shown = [x for y in items for x in (y, *([""] if r.random() < 0.5 else []))]
        elif kind == "p" and r.random() < 0.2:
            shown = [x.replace(" " + x.split(" ")[1] + " ", f" {w.link(x.split(' ')[1])} ", 1) if x.count(" ") > 4 else x for x in items]
        lines += [(x, label) for x in shown]
        if r.random() >= glued:
            lines.append(("", 0))
    return "\n".join(x for x, _ in lines), [y for _, y in lines]


_CLASS = {"menu": ["menu", "topnav", "nav-list"], "consent": ["consent", "cc-banner", "notice"], "legal": ["footer", "bottom", "site-info"], "related": ["sidebar", "rail", "related"], "comments": ["comments", "thread"], "tools": ["tools", "share-bar", "meta-line"], "body": ["content", "story", "post-body", "entry", "text"]}
_TAG = {"menu": "nav", "legal": "footer", "related": "aside", "comments": "section", "body": "main"}


def _as_html(w: _Writer, blocks: list[Block], title: str) -> tuple[str, list[int]]:
    r = w.r
    lines: list[tuple[str, int]] = [("<!doctype html>", 0), (f'<html lang="{w.lang}"><head><meta charset="utf-8">', 0), (f"<title>{title} - {w.site}</title>", 0), ("</head><body>", 0)]
    naming = r.choice(["clear", "clear", "opaque", "none"])
    outer = r.choice(["div", "div", "tag", "td"])
    split_body = r.random() < 0.5
    codes: dict[str, str] = {}
    esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def opening(group: str) -> tuple[str, str]:
        tag = _TAG.get(group, "div") if outer == "tag" else outer
        name = "" if naming == "none" else r.choice(_CLASS[group]) if naming == "clear" else codes.setdefault(group, "c" + "".join(r.choice("0123456789abcdefghij") for _ in range(4)))
        return (f'<{tag} class="{name}">' if name else f"<{tag}>"), f"</{tag}>"

    if outer == "td":
        lines.append(("<table><tr>", 0))
    open_group, close = "", ""
    for kind, items, label in blocks:
        group = "body" if label or (kind in ("byline", "notice", "share", "letter") and not split_body) else {"path": "menu", "byline": "tools", "notice": "tools", "share": "tools", "letter": "tools", "scripts": "legal"}.get(kind, kind)
        if group != open_group:
            if close:
                lines.append((close, 0))
            start, close = opening(group)
            lines.append((start, 0))
            open_group = group
        if kind in ("menu", "related"):
            if kind == "related":
                lines.append((f"<{(t := r.choice(['p', 'div', 'small']))}>{esc(items[0])}</{t}>", 0))
            rest = items if kind == "menu" else items[1:]
            lines += [("<ul>", 0), *[(f'<li><a href="/x">{esc(x)}</a></li>', 0) for x in rest], ("</ul>", 0)]
        elif kind == "headline":
            lines.append((f"<h1>{esc(items[0])}</h1>", 1))
        elif kind == "sub":
            lines.append((f"<h{(k := r.choice('23'))}>{esc(items[0])}</h{k}>", 1))
        elif kind == "list":
            lines += [("<ul>", 0), *[(f"<li>{esc(x)}</li>", 1) for x in items], ("</ul>", 0)]
        elif kind == "quote":
            lines.append((f"<blockquote>{esc(' '.join(items))}</blockquote>", 1))
        elif kind == "table":
            lines += [("<table>", 0), *[("<tr>" + "".join(f"<td>{esc(c)}</td>" for c in x.split("|")) + "</tr>", 1) for x in items], ("</table>", 0)]
        elif kind == "code":
            lines += [("<pre><code>", 0), *[(esc(x), 1) for x in items], ("</code></pre>", 0)]
        elif kind == "scripts" and r.random() < 0.5:
            lines += [(f"<noscript>{esc(x)}</noscript>", 0) for x in items]
        else:
            tag = "p" if label else r.choice(["p", "div", "span", "small"])
            for x in items:
                if label and r.random() < 0.1:
                    lines.append((esc(x) + "<br><br>", 1))
                elif label and r.random() < 0.12:
                    lines += [("<p>", 0), *[(esc(s), 1) for s in x.split(". ")], ("</p>", 0)]
                else:
                    y = esc(x)
                    if label and r.random() < 0.2 and y.count(" ") > 5:
                        a = y.split(" ")
                        y = " ".join([*a[:2], f'<a href="/w">{a[2]}</a>', *a[3:]])
                    lines.append((f"<{tag}>{y}</{tag}>", label))
    if close:
        lines.append((close, 0))
    if outer == "td":
        lines.append(("</tr></table>", 0))
    lines.append(("</body></html>", 0))
    return "\n".join(x for x, _ in lines), [y for _, y in lines]


def labelled_pages(n: int = N_PAGES, seed: int = SEED) -> tuple[Trees, np.ndarray]:
    """Trees of n pages with each node's label; inner nodes have the label of most of what is below."""
    rng = random.Random(seed)
    t = Trees()
    leaf: dict[int, int] = {}
    for page in range(n):
        w = _Writer(rng)
        blocks, title = _blocks(w)
        text, labels = _as_html(w, blocks, title) if rng.random() < 0.5 else _as_text(w, blocks)
        before = len(t.lines)
        add_page(t, page, text)
        for _, no, node in t.lines[before:]:
            leaf[node] = max(leaf.get(node, 0), labels[no])
    out = np.zeros(len(t.page), np.int64)
    votes = np.zeros((len(t.page), 2))
    for node in range(len(t.page) - 1, -1, -1):
        if node in leaf:
            out[node] = leaf[node]
            votes[node, leaf[node]] = 1
        else:
            out[node] = int(votes[node, 1] >= votes[node, 0] and votes[node, 1] > 0)
        if t.parent[node] >= 0:
            votes[t.parent[node]] += votes[node]
    return t, out
