"""Phrases of pages that stand in for content: errors, failures, script notices, challenges and unfilled samples, in four languages, one table a kind.
A phrase is matched in lower case between word ends, anywhere in a passage."""

from __future__ import annotations

PHRASES: dict[str, str] = {
    "status": """
        error 4|error 5|http 4|http 5|400 bad request|401|403|404|410 gone|429|500|502|503|504|access denied|permission denied|forbidden|page not found|not found|bad gateway|service unavailable
        internal server error|server error|gateway timeout|gateway time-out|too many requests|rate limit exceeded|unauthorized|under maintenance|maintenance|you do not have permission|you don't have permission|not permitted
        seite nicht gefunden|zugriff verweigert|página no encontrada|acceso denegado|page introuvable|accès refusé|accès interdit|wartungsarbeiten|en mantenimiento|en maintenance""",
    "missing": """
        page doesn't exist|does not exist|no longer exists|no longer available|isn't here|is not here|could not be found|can't be found|cannot be found|can't find that page|we couldn't find|has moved|has gone|nothing here|page you requested|page you are looking for
        existiert nicht|nicht gefunden|nicht mehr verfügbar|no existe|ya no está disponible|n'existe pas|n'existe plus|n'est plus disponible""",
    "failure": """
        something went wrong|unexpected error|an error occurred|an error has occurred|could not load|couldn't load|failed to load|could not connect|unable to connect|try again later|try again in|come back later|come back in|session has expired|session expired|traceback (most recent call last)
        fatal error|warning:|stack trace|timed out|oops|sorry
        später erneut|ein fehler ist aufgetreten|etwas ist schiefgelaufen|más tarde|se ha producido un error|algo salió mal|réessayer plus tard|réessayez|plus tard|une erreur est survenue""",
    "scripts": """
        enable javascript|enable scripts|turn on javascript|turn javascript on|allow javascript|activate javascript|javascript is disabled|javascript is required|javascript is off|needs javascript|requires javascript|without javascript|scripting is required|enable scripting|browser with scripting|does not run scripts|doesn't support javascript|loading...|loading…
        aktivieren sie javascript|javascript aktivieren|javascript ist deaktiviert|eingeschalteten skripten|javascript benötigt|activez javascript|activer javascript|javascript est désactivé|besoin de scripts|nécessite javascript
        active javascript|activar javascript|javascript está desactivado|necesita javascript|no ejecuta scripts|requiere javascript""",
    "challenge": """
        checking your browser|check your browser|verifying your browser|checking your connection|verifying your connection|are you human|are you a human|are you a robot|not a robot|you are human|that you are a person|that you are a human|security check|human verification|unusual traffic|suspicious activity|automated traffic|automated access|automated visits|automated requests|solve the puzzle|captcha|one moment while|just a moment|please wait while
        prüfen ihren browser|ihr browser wird überprüft|kein roboter|sicherheitsprüfung|vérification de votre navigateur|vérifions votre navigateur|pas un robot|contrôle de sécurité|comprobando su navegador|comprobamos su navegador|no es un robot|control de seguridad""",
    "sample": """
        lorem ipsum|goes here|replace it with|replace this text|replace this with|sample page|sample text|sample content|dummy text|dummy copy|placeholder|text to follow|copy to follow|tbd|insert your|enter your|enter a|insert a|describe your|double-click to edit|double click to edit|click to edit|heading text|your text here|your title here|untitled|test page|test test|coming soon|under construction
        beispieltext|platzhalter|blindtext|texte d'exemple|texte de remplissage|faux texte|texto de ejemplo|texto de relleno""",
}


def phrases(kind: str) -> list[str]:
    return [p for line in PHRASES[kind].strip("\n").split("\n") for p in line.strip().split("|") if p]
