"""Curated phrases of site furniture in four languages, one table a kind. A phrase is matched anywhere in a line, in lower case."""

from __future__ import annotations

PHRASES: dict[str, str] = {
    "legal": """
        ©|(c) 20|copyright|rights reserved|terms of use|terms of service|terms and conditions|privacy policy|imprint|disclaimer|registered office|registered in|company number|without permission|without consent|written consent|written permission|not responsible|responsible for the content|linked pages|external links|not liable|no liability|reproduced
        rechte vorbehalten|impressum|datenschutz|nutzungsbedingungen|geschäftsbedingungen|haftung|nachdruck|sitz der gesellschaft
        droits réservés|mentions légales|conditions d'utilisation|reproduction|siège social|derechos reservados|aviso legal|condiciones de uso|privacidad|se hace responsable|domicilio social""",
    "consent": """
        cookie|cookies|consent|your privacy|privacy settings|privacy choices|your data|personal data|on your device|your device|our partners|accept all|reject all|only necessary|manage preferences
        einwilligung|zustimmung|privatsphäre|ihre daten|alle akzeptieren|vie privée|consentement|vos données|tout accepter|su privacidad|consentimiento|sus datos|aceptar todo""",
    "share": """
        share this|share:|share on|share with|tweet|follow us|copy link|print this|print |e-mail this|email this|send this|to a friend|pin it|did you like
        teilen|weitersagen|an freunde|drucken|partager|envoyer à|à un ami|imprimer|compartir|enviar a|a un amigo|imprimir""",
    "byline": """
        min read|minute read|minutes read|reported by|written by|posted by|edited by|staff for|staff writer|by the |by our | desk|correspondent|published on|posted on|updated on|last updated|team, |supplement
        lesezeit|von der redaktion|unserer redaktion|veröffentlicht am|aktualisiert am|min de lecture|lecture :|par la rédaction|notre rédaction|publié le|mis à jour le|min de lectura|por la redacción|nuestra redacción|publicado el|actualizado el""",
    "letter": """
        newsletter|subscribe|unsubscribe|sign up for|your e-mail|your email|email address|our letter|our digest|letter every|without ads|without advertising|no spam|your inbox|become a member|members of|members read|every morning|every week
        abonnieren|newsletter|der brief von|jeden morgen|ihre e-mail|mitglied werden|s'abonner|abonnez-vous|la lettre de|chaque matin|votre e-mail|suscríbase|suscribirse|la carta de|cada mañana|su correo""",
    "comments": """
        comments|leave a comment|leave a reply|post a comment|add a comment|join the discussion|join the conversation|what do you think|be the first to comment
        kommentare|kommentar schreiben|kommentieren|antworten|commentaires|laisser un commentaire|réagir|répondre|comentarios|deje un comentario|comentar|responder""",
    "related": """
        you may also|you might also|related|most read|most popular|popular this|trending|read next|read more|up next|more from|more on|more stories|recommended|latest entries|latest posts|latest news|don't miss|editor's picks
        lesen sie auch|meistgelesen|am beliebtesten|beliebt|mehr zum thema|mehr von|verwandte|weitere artikel|à lire aussi|les plus lus|sur le même|en ce moment|articles liés|lire aussi|lo más leído|también le puede|le puede gustar|más del tema|más de |relacionados|lea también|ahora""",
    "path": """
        you are here|sie sind hier|vous êtes ici|está aquí|usted está""",
    "notice": """
        advertisement|advertising|sponsored|promoted|story continues|article continues|continue reading|our app|correction:|clarification:|editor's note|editors' note|earlier version|was amended|was corrected|has been updated|part of a series|this article is part
        anzeige|werbung|gesponsert|hinweis der redaktion|anm. d. red|korrektur:|berichtigt|text ergänzt|publicité|sponsorisé|la suite après|note de la rédaction|rectificatif|texte corrigé|publicidad|patrocinado|continúa tras|nota de la redacción|corrección:|texto corregido""",
    "scripts": """
        javascript|run scripts|enable scripts|allow scripts|need scripts|needs scripts|scripting|noscript|skripten|ejecuta scripts|besoin de scripts|les scripts|scripts activados""",
    "menu": """
        home|news|latest|world|business|sport|culture|opinion|video|shop|store|cart|search|topics|sections|archive|archives|about|about us|contact|contact us|help|faq|support|jobs|careers|events|calendar|products|services|solutions|pricing|prices|blog|press|downloads|docs|forum|community|members|log in|login|sign in|sign up|register|subscribe|account|my account|menu|more
        startseite|nachrichten|aktuelles|themen|suche|archiv|über uns|kontakt|hilfe|stellen|karriere|produkte|preise|laden|anmelden|registrieren|termine|mediathek
        accueil|actualités|thèmes|rubriques|recherche|archives|à propos|contact|aide|emplois|produits|tarifs|boutique|connexion|s'inscrire|agenda|nouveautés
        inicio|portada|noticias|temas|secciones|buscar|archivo|nosotros|quiénes somos|contacto|ayuda|empleo|productos|precios|tienda|entrar|registrarse|agenda|descargas""",
}

#: Class and id names (parts of them) of containers, and tags, that hold furniture or the body.
FURNITURE_NAMES = """nav menu foot bottom consent cookie banner notice share tool meta aside side rail relat comment respons thread reply site-info legal
    crumb social promo advert sponsor newsletter subscribe widget popular trending login search""".split()
BODY_NAMES = "content story text entry post body article main".split()
FURNITURE_TAGS = frozenset("nav footer aside form button select noscript header menu dialog".split())
BODY_TAGS = frozenset("main article".split())


def phrases(kind: str) -> list[str]:
    return [p for line in PHRASES[kind].strip("\n").split("\n") for p in line.strip().replace(" | ", " ¦ ").split("|") if p]
