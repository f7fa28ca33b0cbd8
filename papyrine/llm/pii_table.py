"""The small labelled table the recogniser of personal data is trained on, and how its rows are varied.

A row is a sentence with slots. ``{nom}``, ``{courriel}``, ``{telephone}``, ``{identite}`` and ``{adresse}`` are filled with
invented personal data and labelled; ``{lieu}``, ``{code}`` and ``{phrase}`` are filled with look-alikes and ordinary
clauses and are not labelled.
"""

from __future__ import annotations

import random
import re

#: First names.
FIRST_NAMES = (
    "Adrien Agathe Alain Alice Amélie Amina André Anne Antoine Arnaud Arthur Audrey Aurélie Awa Baptiste Bastien Benoît Bernard Brigitte "
    "Camille Caroline Catherine Cécile Charlotte Chloé Christine Christophe Claire Clarisse Claude Clément Corinne Cyril Damien Daniel David "
    "Delphine Denis Denise Didier Dominique Eddy Élise Élodie Elvire Emma Emmanuel Éric Estelle Étienne Eva Fabien Fabrice Fanny Farid Fatima "
    "Florence Florian Franck François Françoise Frédéric Gabriel Gaspard Gérard Gilles Grégory Guillaume Hélène Henri Hervé Hugo Idris Inès "
    "Isabelle Jacques Jean Jérémy Jérôme Joël Julie Julien Karim Karine Laura Laurence Laurent Léa Léo Loïc Louis Louise Luc Lucas Lucie "
    "Maëlle Manon Marc Marie Martine Mathieu Mathis Maxime Mehdi Mélanie Michel Mohamed Monique Myriam Nadège Nadia Nathalie Nicolas Nicole Noémie "
    "Odile Olivier Pascal Patricia Patrick Paul Philippe Pierre Quentin Rachid Raphaël Régis Rémi Robert Romain Romane Sacha Samira Samuel "
    "Sandrine Sarah Sébastien Serge Simon Solène Sonia Sophie Stéphane Sylvie Thierry Thomas Tiago Valérie Véronique Vincent Virginie "
    "Xavier Yann Yasmine Youssef Ysaline Yves Zoé"
).split()
#: Titles before a name, and words that begin a street name.
TITLES = "M. Mme Mlle Melle Mr Monsieur Madame Mademoiselle Dr Docteur Pr Professeur Me Maître".split()
STREETS = "rue avenue av av. boulevard bd bd. bld place pl pl. chemin ch. impasse imp. quai route rte allée all. cours square passage sentier faubourg".split()

ROWS = """
{phrase}
{phrase}. {phrase}
{phrase}, {phrase}
{phrase} ; {phrase}
demander à {nom} le support
merci à {nom} pour sa patience
avec {nom} on avance mieux
{nom} explique très clairement
{nom} et moi avons fini en avance
signé {nom}
l'animateur ({nom}) parlait trop bas
la formatrice ({nom}) allait trop vite
trop de bavardages côté {nom}
binôme avec {nom} compliqué
je voudrais revoir ce point avec {nom}
l'intervention de {nom} était trop courte
les explications de {nom} nous ont aidés
voir avec {nom} pour la suite
{nom} n'était pas disponible
{nom}, {telephone}
{nom} ({telephone})
{nom} <{courriel}>
{nom} ({courriel}) attend une réponse
signé {nom}, {courriel}
merci à {nom} ({telephone})
avec {nom}, {telephone}
mon collègue {nom} n'a pas reçu la convocation
d'après {nom}, le rythme convenait bien
nous remercions {nom} et {nom}
j'ai travaillé avec {nom} puis avec {nom}
écrire à {courriel} pour la suite
mail : {courriel}
me recontacter sur {courriel} svp
support à envoyer à {courriel}
{courriel}
joignable au {telephone} après 17 h
sms possible : {telephone}
merci de me rappeler ({telephone})
tél. {telephone}
{telephone}
{telephone}, le soir
mon numéro de sécurité sociale {identite} mal saisi sur l'attestation
n° sécu {identite}
NIR : {identite} à corriger
pièce d'identité {identite}
passeport {identite} périmé
carte d'identité n° {identite}
j'habite {adresse}, trop loin du site
j'habite {adresse}
envoyer l'attestation au {adresse}
adresse : {adresse}
désormais {adresse}
courrier à adresser {adresse}
la salle {lieu} est trop petite
le bâtiment {lieu} manque de prises
l'outil {lieu} est lent
la méthode {lieu} mérite plus de temps
le logiciel {lieu}@poste plante souvent
le module {lieu} était clair
la session de {lieu} était plus calme
la ville de {lieu} est loin
on est venus de {lieu} en train
le lot {code} servait d'exemple
dossier n° {code} rangé ailleurs
noter {date} et {date} au planning
budget de {montant} € évoqué trop vite
refaire les exercices {liste}
passer de {liste} à {petit}
pause à {petit} h {petit} au lieu de {petit} h {petit}
la fiche {petit} chemin critique est utile
le cas {petit} route barrée manquait
étape {petit} passage en caisse à revoir
les {petit} places du parking sont prises
sur une échelle de {petit} à {petit} je mets {petit},{petit}
article {code} du règlement
{petit} répétitions suffisent
page {petit} du livret
module {petit} séquence {petit} page {petit}
fiche de stage {code} illisible
{petit} inscrits sur {petit} jugent le contenu inégal
rue trop bruyante à côté de la salle
la place des exercices est trop petite
""".strip().split("\n")

#: Ordinary clauses.
CLAUSES = """
la planification des tournées en fin de session et le suivi des stocks
c'était bien construit à l'aide du tableau blanc
le formateur a illustré la démonstration avec des schémas simples
à refaire chaque année sur l'inventaire annuel, mais le temps a manqué
rien à signaler
ras
il faudrait prévoir une journée de plus pour l'accueil téléphonique
D'après la coordinatrice, la gestion des priorités reste utile
Sur le plateau technique, le tuteur d'entreprise a repris le cas pratique
la moitié des inscrits attendait plus d'exercices
plutôt clair pour la saisie des heures, trop rapide pour le reste
une stagiaire du soir a comparé les deux versions du document
le référent technique a préparé les questions
l'éclairage des postes devant toute la classe
À l'aide du tableau blanc, le groupe a remis à plat le sujet
le chargé de suivi a validé l'ensemble dès le premier jour
Chaque binôme a terminé les consignes en sous-groupes
la promotion entière a apprécié la vidéo
pas de sujet particulier
vraiment concret, ce qui donne envie de continuer
les consignes changeaient souvent et la salle était trop froide
Des exemples filmés de la conduite de projet par petites étapes
un parrainage pour la prise de parole lors du dernier atelier
les locaux sont difficiles à trouver
le matériel était incomplet et la pause trop courte
L'atelier du matin a découvert le rappel théorique
le support papier sur la lecture des plans est dense
notre équipe de nuit a discuté l'étude de cas
""".strip().split("\n")

HEADS = "Bel Bru Car Cha Del Dom Fre Gar Gui Hau Ker Lam Lar Mon Mar Or Per Pri Rou Sal Tar Val Vau Ver Bou Cor Des Du Fau Gir Jou Len Mou Nor Pas Que Ray Ser".split()
MIDDLES = "ber bri cas cha doi for gui lou mar min nor pil pon rin ron ta vi vin zel dri gue mon ra lan tre ve".split()
TAILS = "ac anne ard aud eau ec el enne er et ette ier in ine on ot oux uet ueux ais and aux ert is ois ou y".split()
COMMON_SURNAMES = "Martin Bernard Dubois Robert Richard Petit Durand Leroy Moreau Simon Lefebvre Michel Garcia Fournier Girard Bonnet Lambert Fontaine Rousseau Vincent Muller Faure Mercier Blanc Guerin Boyer Garnier Chevalier Legrand Gauthier Perrin Robin Masson Nguyen Diallo Benali Traoré Lopez Ferreira".split()
PLACES = "Bréhonnec Camomille Fluvio Rosalie Pythagore Mistral Vendôme Kanbano Horizon Agora Amandier Lorient Valmont Montessori Cornell Ishikawa Pomodoro Atlas Sirius Bellevue".split()
WAYS = "de la Houle|des Tanneurs|du Vieux-Lavoir|de Valdorme|aux Sables|du Four|des Sorbiers|de l'Ancien-Marché|des Quatre-Vents|Victor Hugo|Jean Jaurès|de la République|du Moulin|des Écoles|de la Gare|Pasteur|des Lilas|du Général Leclerc|aux Herbes|d'Alsace".split("|")
TOWNS = "Tournelac|Valdorme|Saint-Orvin|Grandbois-sur-Aune|Pont-Lézan|Courtebise|Maréville-le-Haut|Brumecourt|Villeneuve|Saint-Martin|Belleroche".split("|")


def surname(r: random.Random) -> str:
    if r.random() < 0.25:
        return r.choice(COMMON_SURNAMES)
    return r.choice(HEADS) + (r.choice(MIDDLES) if r.random() < 0.8 else "") + r.choice(TAILS)


def person(r: random.Random) -> tuple[str, str]:
    """(title with its blank, name)."""
    first, last, style = r.choice(FIRST_NAMES), surname(r), r.random()
    if style < 0.1:
        last = f"{last}-{surname(r)}"
    elif style < 0.2:
        last = f"de {last}"
    title = r.choice(TITLES) + " " if r.random() < 0.25 else ""
    form = r.random()
    if title and form < 0.6:
        name = last
    elif form < 0.08:
        name = first
    elif form < 0.16 and first[0] != "M":  # M. is a title
        name = f"{first[0]}. {last}"
    elif form < 0.26:
        name = f"{last.upper()} {first}"
    elif form < 0.4:
        name = f"{first} {last.upper()}"
    else:
        name = f"{first} {last}"
    if r.random() < 0.14:
        title, name = title.lower(), name.lower()
    return title, name


def digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def telephone(r: random.Random) -> str:
    d = "0" + r.choice("1234567") + digits(r, 8)
    if r.random() < 0.2:
        d = "O" + d[1:]
    pairs = [d[i : i + 2] for i in range(0, 10, 2)]
    style = r.random()
    if style < 0.45:
        between = r.choice([" ", ".", "-", " "])
        return ("/" if style < 0.09 else between).join(pairs)  # no draw of its own, so the other rows stay as they are
    if style < 0.6:
        return d
    if style < 0.7:
        return f"{d[:4]} {d[4:7]} {d[7:]}"
    prefix = r.choice(["+33", "0033", "+33 ", "0033 ", "+33 (0)"])
    rest = d[1:]
    return prefix + (rest if r.random() < 0.4 else " ".join([rest[0], *(rest[i : i + 2] for i in range(1, 9, 2))]))


def identity(r: random.Random) -> str:
    style = r.random()
    if style < 0.55:
        sex, year, month, place, town, order, key = r.choice("12"), digits(r, 2), f"{r.randint(1, 12):02}", digits(r, 2), digits(r, 3), digits(r, 3), digits(r, 2)
        kind = r.random()
        if kind < 0.3:
            return sex + year + month + place + town + order + key
        if kind < 0.5:
            return sex + year + month + place + town + order + " " + key
        if kind < 0.75:
            return " ".join((sex, year, month, place, town, order, key))
        if kind < 0.95:
            return ".".join((sex, year, month, place, town, order)) + "/" + key
        return sex + year + month + place + town + order
    if style < 0.75:
        return digits(r, 2) + "".join(r.choice("ABCDEFGHJKLMNPRSTVWXYZ") for _ in range(2)) + digits(r, 5)
    letters = "BCDFGHJKLMNPRTVWXYZ0123456789"
    while True:
        text = "".join(r.choice(letters) for _ in range(9 if r.random() < 0.5 else 5)).ljust(9, "#")
        text = "".join(r.choice("0123456789") if c == "#" else c for c in text)
        if re.search(r"\d", text) and re.search("[A-Z]", text):
            return text


def courriel(r: random.Random) -> str:
    plain = lambda s: s.lower().translate(str.maketrans("éèêëàâîïôöûüçÉ", "eeeeaaiioouuce"))
    first, last = plain(r.choice(FIRST_NAMES)), plain(surname(r))
    local = r.choice([f"{first}.{last}", f"{last}_{first}", f"{first[0]}{last}", f"{last}-{first[0]}", f"{first}{r.randint(1, 99)}", f"{first}.{last}+stage"])
    domain = r.choice(["cfp-brumecourt.example", "poste-lezan.example", "boite.courtebise.example", "mail-dorme.invalid", "exemple.fr", "courrier.exemple.org", "gmail.test"])
    style = r.random()
    if style < 0.7:
        text = f"{local}@{domain}"
    elif style < 0.8:
        text = f"{local} @ {domain}"
    elif style < 0.9:
        text = f"{local}[at]{domain}"
    else:
        text = f"{local} (at) {domain.replace('.', ' (point) ')}"
    return text.upper() if r.random() < 0.08 else text


def adresse(r: random.Random) -> str:
    number = str(r.randint(1, 150)) + r.choice(["", "", "", " bis", " ter", "bis", ","])
    text = f"{number} {r.choice(STREETS)} {r.choice(WAYS)}"
    end = r.random()
    if end < 0.35:
        text += f", 99{digits(r, 3)} {r.choice(TOWNS)}"
    elif end < 0.55:
        text += f" {r.choice(TOWNS)}"
    return text.upper() if r.random() < 0.08 else text


SLOTS = {"courriel": courriel, "telephone": telephone, "identite": identity, "adresse": adresse}


def sentence(row: str, r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans = "", []
    for part in re.split(r"(\{\w+\})", row):
        slot = part[1:-1] if part.startswith("{") else ""
        if not slot:
            text += part
            continue
        if slot == "nom":
            title, value = person(r)
            text += title
        elif slot in SLOTS:
            value = SLOTS[slot](r)
        elif slot == "phrase":
            value = r.choice(CLAUSES)
        elif slot == "lieu":
            value = r.choice(PLACES) if r.random() < 0.7 else surname(r)
        elif slot == "code":
            value = r.choice([f"{digits(r, 8)}-{digits(r, 4)}", digits(r, 12), f"ST-{digits(r, 4)}-{digits(r, 2)}", f"L{digits(r, 4)}-{digits(r, 1)}", digits(r, 6)])
        elif slot == "date":
            value = r.choice("/.").join((f"{r.randint(1, 28):02}", f"{r.randint(1, 12):02}", "20" + digits(r, 2)))
        elif slot == "montant":
            value = r.choice([f"{r.randint(1, 9)} {digits(r, 3)} {digits(r, 3)}", f"{r.randint(10, 99)} {digits(r, 3)}"])
        elif slot == "liste":
            a = r.randint(1, 60)
            value = " ".join(f"{a + k * r.randint(1, 3):02}" for k in range(r.choice([3, 4, 4, 5])))
        else:
            value = str(r.randint(1, 60))
        if slot in SLOTS or slot == "nom":
            spans.append((len(text), len(text) + len(value), slot))
        text += value
    return text, spans


def labelled_table(size: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``size`` labelled texts: rows in turn, varied, some of them between ordinary clauses as answers are."""
    r = random.Random(seed)
    out = []
    for k in range(size):
        text, spans = sentence(ROWS[k % len(ROWS)], r)
        while r.random() < 0.45:
            more, extra = (r.choice(CLAUSES), []) if r.random() < 0.7 else sentence(r.choice(ROWS), r)
            joint = r.choice([". ", ", ", " ; ", "\n", " - ", " / "])
            if r.random() < 0.5:
                spans = spans + [(a + len(text) + len(joint), b + len(text) + len(joint), g) for a, b, g in extra]
                text = text + joint + more
            else:
                spans = extra + [(a + len(more) + len(joint), b + len(more) + len(joint), g) for a, b, g in spans]
                text = more + joint + text
        if r.random() < 0.3:
            text += r.choice([".", "...", " !", " "])
        if r.random() < 0.3 and text and not (spans and spans[0][0] == 0):
            text = text[0].upper() + text[1:]
        out.append((text, spans))
    return out
