"""Curated terms of the subjects, a table each, in English, French, German and Spanish. A term may have a weight after "^" (1 without)."""

from __future__ import annotations

TERMS: dict[str, str] = {
    "science": """physicist|chemist|astronomer|geologist|biologist|laboratory|lab group^0.8|enzyme|isotope|telescope|spectrum^0.8|particle|polymer|sediment|genome|hypothesis|experiment^0.8|cell culture|control group|larva|plasma chamber|reaction rate
        physicien|physicienne|chimiste|géologue|laboratoire|télescope|génome|isotope|culture cellulaire|spectre|atomique
        physikerin|physiker|chemikerin|labor|teleskop|isotop|genom|zellkultur|atommodell|spektrum|enzym
        físico|física|química|geóloga|laboratorio|telescopio|genoma|isótopo|cultivo celular|espectro|enzima""",
    "law": """judge|court order|tribunal|lawsuit|solicitor|claimant|defence counsel|injunction|verdict|statute|liability|appeal^0.7|legislation|contract law|tenancy|custody|burden of proof|trade mark|hearing date|witness|clause^0.8|draft bill|licence term
        juge|tribunal|avocate|avocat|verdict|jugement|bail|audience|loi|plaignant|contrat|marque
        richterin|richter|gericht|klägerin|urteil|mietvertrag|datenschutzgesetz|anwältin|anwalt|vergleich^0.7|gesetz|klage
        jueza|juez|tribunal|abogada|abogado|sentencia|veredicto|ley de privacidad|contrato|demandante|audiencia""",
    "sport": """striker|goalkeeper|midfielder|coach|referee|tournament|league table|penalty|marathon|sprinter|tennis|qualifier|squad|season record|half-time|cup draw|away match|rower|training pitch|doping
        entraîneur|gardien|championnat|match|finale|marathon|joueuse|équipe de relais|arbitre|but^0.5
        trainerin|trainer|torwart|torhüterin|meisterschaft|pokal|finale|stürmerin|rückspiel|marathon|mannschaft
        entrenador|entrenadora|portera|portero|campeonato|partido|final^0.6|entrenamiento|maratón|delantera|árbitra""",
    "software": """compiler|stack trace|database index|memory leak|race condition|unit test|release branch|rollback|maintainer|backend|deploy script|command line|type checker|query planner|build cache|thread pool|container image|refactored|debugged|source code|programmer
        développeuse|développeur|compilateur|base de données|fuite de mémoire|test unitaire|branche|version^0.5|logiciel|bibliothèque logicielle
        programmiererin|compiler|datenbank|speicherleck|komponententest|programmbibliothek|release|software|entwicklerin
        programadora|compilador|base de datos|fuga de memoria|prueba unitaria|rama|equipo técnico|biblioteca de software""",
    "webdata": """crawler|crawl|sitemap|robots file|scraping|spider|page snapshot|feed parser|canonical link|redirect chain|seed list|rate limiter|content selector|fetch log|hostname|duplicate page|link graph|response header|cookie jar|screenshot job|markdown export
        collecteur|plan du site|fichier robots|extraction du contenu|équipe de collecte|robot d'indexation|flux|collecte
        robots-datei|sitemap|crawler|sammler|abrufprotokoll|seiteninhalt|webseite|crawl
        rastreador|mapa del sitio|archivo robots|extracción de contenido|registro de descargas|rastreo|recolector""",
    "health": """nurse|surgeon|patient|pharmacist|midwife|clinic|vaccine|prescription|migraine|blood pressure|insulin|inhaler|screening|infection|physiotherapy|wound|dental|allergy|hip replacement|ward round|heart rhythm
        infirmière|infirmier|patient|ordonnance|vaccin|dépistage|rééducation|migraine|chirurgienne|médecin
        pflegerin|patient|rezept^0.7|impfung|vorsorge|migräne|verband^0.6|ärztin|arzt|klinik
        enfermera|paciente|receta^0.6|vacuna|migraña|rehabilitación|médica|médico|clínica|cirujana""",
    "finance": """bank|central bank|lender|dividend|bond yield|mortgage|hedge|broker|auditor|treasurer|ledger|inflation|insurance premium|pension fund|exchange rate|savings rate|cash flow|credit line|share price|tax return|budget gap
        banque|taux d'épargne|obligation|prêt immobilier|bilan|budget|impôt|investisseuse|inflation
        bank|anlegerin|sparquote|hypothek|anleihe|bilanz|haushalt|aktie|steuer|inflation
        banco|inversora|tasa de ahorro|hipoteca|bono|balance|presupuesto|acción|impuesto""",
    "food": """grocer|chef|cook|kitchen team|tasting|recipe|frying pan|noodle soup|sourdough|almond|lentil|plum cake|butter sauce|spice mix|roasted pepper|pickled|fermented|oven|dinner menu|side dish|mushroom
        cuisinière|boulanger|four|poêle|soupe|sauce|tarte|levain|huile|gâteau
        köchin|bäcker|pfanne|ofen|linsensuppe|kräuteröl|buttersoße|pflaumenkuchen|sauerteigbrot
        cocinera|panadero|horno|sartén|sopa|salsa|pastel|masa madre|aceite""",
    "travel": """traveller|backpacker|tour guide|hostel|ferry|night train|passport|suitcase|airport|hiking trail|island bus|river cruise|mountain hut|harbour walk|guest house|cyclist|lighthouse|border crossing|camping site|city map|itinerary
        voyageuse|voyageur|refuge|bateau|train de nuit|sentier|phare|passeport|auberge|randonneuse
        reisende|wanderin|nachtzug|fähre|hütte|leuchtturm|reisepass|wanderweg|herberge|insel
        viajera|viajero|tren nocturno|refugio|faro|sendero|pasaporte|albergue|transbordador""",
    "arts": """painter|composer|novelist|sculptor|choreographer|curator|ensemble|orchestra|string quartet|sculpture|exhibition|opera|puppet show|oil painting|novel^0.8|poem|mural|gallery|stage set|short film|manuscript|portrait|dance piece
        peintre|compositrice|romancière|exposition|sculpture|peinture à l'huile|quatuor|roman|poème|scène|galerie
        malerin|maler|komponistin|ausstellung|skulptur|ölgemälde|streichquartett|roman|gedicht|bühne|bühnenbild
        pintor|pintora|compositora|exposición|escultura|pintura al óleo|cuarteto|novela|poema|escenario""",
    "history": """historian|archaeologist|chronicler|archivist|monarch|envoy|dynasty|siege|fortress|peasant revolt|royal charter|census roll|border treaty|peace congress|guild hall|colonial port|naval blockade|burial mound|coin hoard|trade route|harvest tax|monastery|old map|letter archive
        historienne|historien|chroniqueur|dynastie|siège|traité|monastère|charte royale|archives^0.6|révolte
        historikerin|chronist|dynastie|belagerung|vertrag^0.6|kloster|urkunde|aufstand|archiv^0.6
        historiadora|cronista|dinastía|asedio|tratado|monasterio|carta real|archivo^0.6|revuelta""",
    "education": """teacher|pupil|lecturer|tutor|classroom|homework|syllabus|exam board|term paper|maths lesson|school year|school board|lesson plan|reading test|tuition|seminar|scholarship|graduation|nursery place|spelling list|library card|head teacher
        enseignante|enseignant|élève|salle de classe|devoirs|cours^0.5|examen|bourse|école|dictée
        lehrerin|lehrer|schülerin|schüler|klassenzimmer|hausaufgabe|prüfung|stipendium|schule|lehrplan|diktat
        maestra|maestro|alumna|alumno|aula|deberes|examen|beca|escuela|dictado""",
}


def terms(subject: str) -> dict[str, float]:
    out: dict[str, float] = {}
    for part in TERMS[subject].replace("\n", "|").split("|"):
        term, _, weight = part.strip().partition("^")
        if term:
            out[term] = float(weight or 1)
    return out
