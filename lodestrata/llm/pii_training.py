"""Labelled spans for the model of personal information, made from invented persons, and its training.

    python -m lodestrata.llm.pii_training OUT.npz [FROM.npz LEGS_DONE]

Every example is a stretch of text with the spans of the values in it. The words around them are drawn from a public
tokenizer's vocabulary, from short lists of everyday words and cue phrases of four languages and from the Python
documentation that comes with the interpreter; sentences are put together at random. Texts like the ones searched were
known when the lists were written, and about a third of the phrases stand in them. Training runs a fixed number of batches
from fixed seeds.
"""

from __future__ import annotations

import base64
import random
import re
import sys
import unicodedata

import numpy as np

from .encoding import VOCABULARIES
from .pii_model import FRAME, HIDDEN, KINDS, WIDE, Adam, _run, emissions, encode, loss_and_gradient, start, viterbi

LENGTH = 32 * FRAME

# fixed values: given names and family names of several countries, and parts of such names
GIVEN = (
    "James Mary Robert Linda Michael Susan David Karen William Nancy Thomas Sarah Charles Laura Daniel Emma Paul Alice Mark Julia Peter Anna Hans "
    "Klaus Greta Jürgen Heike Wolfgang Sabine Uwe Katrin Pierre Marie Jean Claire Luc Amélie René Hélène Carlos María José Lucía Javier Pilar Íñigo "
    "Núria Giulia Marco Sofia Lars Ingrid Søren Astrid Jiří Zdeněk Agnieszka Paweł Olga Ivan Dmitri Yuki Kenji Mei Li Priya Arjun Fatima Omar Aisha Kwame Zoë Björn Ludwig Pat Tom Ben"
).split()
FAMILY = (
    "Smith Jones Brown Taylor Wilson Evans Walker White Green Hall Clarke Hughes Baker Carter Cooper Ward Turner Morgan Bell Murphy Kelly Müller Schmidt "
    "Schneider Fischer Weber Becker Wagner Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Dubois Moreau Laurent Lefèvre Girard Roux Fournier "
    "Garçon García López Martínez Sánchez Pérez Gómez Núñez Ruiz Ortega Castro Rossi Ferrari Bianchi Hansen Nilsson Larsen Novák Dvořák Kowalski Wójcik "
    "Petrov Ivanova Tanaka Suzuki Chen Wang Singh Patel Khan Haddad Mensah Okafor Beethoven Fuente Berg Lange Vogel Falk Quist"
).split()
ONSET = "b br c ch cl d dr f fl fr g gr h j k kl l m n p ph pr qu r s sch sh sk sl st sv t th tr v w wr y z".split()
VOWEL = "a a e e i i o o u y ae ai au ea ei ia ie io oa ou é ö ü á ó í ø å".split()
CODA = ["", "", "", "", "l", "n", "r", "s", "t", "m", "d", "k", "ld", "lm", "nd", "nt", "rd", "rn", "rk", "st", "th", "ck", "ss", "x"]
SUFFIX = "son ton ley ford field wood man mann berg stein er ez ski ova sen ini ard eau well worth ham by more land bridge wick stead hurst dale gate low den sham combe grove brook bury ridge stone thorpe shaw".split()
PARTICLES = ["van", "von", "de", "de la", "da", "del", "di", "van der", "von der", "le", "bin", "ten", "dos"]
CLOSING = ["Regards,", "Best regards", "Kind regards,", "Cheers,", "Thanks,", "Best,", "Yours sincerely,", "Mit freundlichen Grüßen", "Viele Grüße", "Gruß", "Cordialement,", "Bien à vous,", "Saludos,", "Un saludo,", "Atentamente,", "--", "-- "]

# fixed values: everyday words of four languages
WORDS = {
    "en": "the a of to and in is that for it as was with be by on not this but are from or have an they which one you were all there would their we when who will no more if out so said what up its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too mr how little good world make very year still see work life being against between never another while last might us great old both".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn Haus Zeile Datei Prüfung Größe Lauf Schritt Wert Zeit Ordner Fehler Liste Länge Seite Tag Woche Jahr Kunde Auftrag Straße Stadt Werkzeug Rechner Fenster Zwischenspeicher Grenze Anfrage Antwort Umbau Änderung Ausgabe Eingabe Speicher Begriff Stelle Abschnitt Aufrufer Ablage Muster Name Nummer Bitte Beispiel prüfen ändern lesen schreiben findet fehlt fehlen steht liegt braucht langsam schnell".split(),
    "fr": "le la les de des du un une et à en dans est que qui pour ne pas sur par plus avec ce il au sont se cette mais ou nous vous ils elle son sa ses leur comme tout être fait été aussi depuis après avant encore deux fichier ligne lignes dossier taille valeur erreur fenêtre dépôt analyse mise jour appelant contrôle morceau recherche requête réponse étape page essai numéro compte bureau maison ville rue temps semaine année merci voir lire écrire prend manque dépend déplacer".split(),
    "es": "el la los las de del un una y a en que es por con para no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante archivo línea líneas carpeta tamaño valor error ventana depósito análisis cambio tras llamada control trozo búsqueda consulta respuesta paso página prueba número cuenta oficina casa ciudad calle tiempo semana año gracias ver leer escribir tarda falta depende mover".split(),
}
CUES = {
    "email": "email e-mail mail contact reply_to reply-to from to cc bcc sender recipient kontakt courriel correo owner user author mailto notify support_contact correo_electronico".split(),
    "phone": "phone tel tel. mobile cell fax call telephone hotline telefon handy rufnummer mobil téléphone tél portable teléfono tfno móvil phone_number on-call contact_phone".split(),
    "id_number": "ssn social_security_number social security passport passport_no passport number tax_id tax id national_id id_card identity card nino insurance number steuer-id steuernummer ausweis ausweisnummer reisepass personalausweis nir sécurité sociale passeport dni nie nif pasaporte id_number taxpayer".split(),
    "address": "address addr street office home shipping_address billing_address postal anschrift adresse wohnort lieferadresse dirección domicilio delivery location lives at ship to".split(),
    "name": "name author owner assignee assigned to reviewer reviewed-by reported by user full_name contact person customer maintainer verfasser bearbeiter gemeldet von auteur signalé par nombre autor responsable informado por cc attn editor approver translator".split(),
}
LEADS = {
    "email": ["write to", "send it to", "mail", "forward this to", "ping", "reach us at", "ask", "bitte an", "schreiben an", "écrire à", "envoyer à", "escribir a", "enviar a", "copy", "contact"],
    "phone": ["call", "text", "ring", "dial", "reach me at", "phone", "his number is", "anrufen unter", "erreichbar unter", "telefonisch unter", "appeler le", "joignable au", "llamar al", "number", "fax to"],
    "id_number": ["the passport", "her social security number", "a tax number", "identity card no.", "the ssn", "insurance number", "die Steuernummer", "Ausweis Nr.", "Reisepass", "le numéro de sécurité sociale", "passeport n°", "el DNI", "NIF", "NIE", "pasaporte", "national id"],
    "address": ["send the parcel to", "lives at", "ship to", "deliver to", "moved to", "our office is at", "wohnt in", "liefern an", "senden an", "habite au", "livrer au", "envoyer au", "vive en", "enviar a", "entregar en", "the house at"],
    "name": ["ask", "thanks to", "according to", "spoke with", "signed by", "assigned to", "written by", "met", "cc", "ping", "laut", "bitte an", "gemeldet von", "Rückfragen an", "selon", "merci à", "voir avec", "signalé par", "gracias a", "según", "preguntar a", "hablé con", "please ask", "reported by", "with", "from", "Mr", "Mrs", "Ms", "Dr.", "Prof.", "Herr", "Frau", "Señor", "Mme"],
}
AFTER = {
    "name": ["has looked at it", "agreed", "will merge it", "is on leave", "said so", "wrote the test", "before the release", "today", "hat es geprüft", "ist heute nicht da", "l'a déjà vu", "est en congé", "ya lo vio", "lo ha revisado", "about it", "on the phone", "and others", "before merging", "first", "in the review", "wrote this", "broke the build", "rotated the keys"],
    "other": ["today", "please", "if it breaks", "by mistake", "in plain text", "in the ticket", "was leaked", "at noon", "after lunch", "schicken", "steht im Klartext", "en clair", "aparece en claro", "is in the sample", "must be removed", "says the form", "not the channel", "instead"],
}


def vocabulary(folder: str = VOCABULARIES) -> list[str]:
    """Lower-case words of two public tokenizer vocabularies."""
    found = set()
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        with open(f"{folder}/{name}", "rb") as lines:
            for line in lines:
                try:
                    token = base64.b64decode(line.split()[0]).decode()
                except UnicodeDecodeError:
                    continue
                if re.fullmatch(r" [a-zß-öø-ÿ]{3,12}", token):
                    found.add(token[1:])
    return sorted(found)


def prose() -> str:
    """English text on programming, without persons: the documentation topics of the interpreter."""
    from pydoc_data import topics

    return "\n".join(text for _, text in sorted(topics.topics.items()) if "@" not in text[:50])


class Maker:
    _shared: tuple[list[str], str] | None = None

    def __init__(self, seed: int, more_names: int = 1):
        self.kinds = KINDS * 2 + ("name",) * more_names + ("phone", "id_number")
        if Maker._shared is None:
            Maker._shared = vocabulary(), prose()
        self.words, self.prose = Maker._shared
        self.r = random.Random(seed)

    def pick(self, items):
        return self.r.choice(items)

    def chance(self, share: float) -> bool:
        return self.r.random() < share

    def digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def number(self) -> str:
        return str(self.r.randint(0, 10 ** self.r.randint(1, 5)))

    def word(self) -> str:
        return self.pick(self.words)

    def ident(self) -> str:
        parts = [self.word() for _ in range(self.r.randint(1, 3))]
        form = self.r.random()
        if form < 0.4:
            return "_".join(parts)
        if form < 0.55:
            return "_".join(parts).upper()
        if form < 0.75:
            return "".join(x.title() for x in parts)
        return parts[0] + "".join(x.title() for x in parts[1:])

    def syllables(self, low: int, high: int) -> str:
        return "".join(self.pick(ONSET) + self.pick(VOWEL) + self.pick(CODA) for _ in range(self.r.randint(low, high)))

    def first(self) -> str:
        return self.pick(GIVEN) if self.chance(0.3) else (self.pick(("", "", self.pick("aeiou"))) + self.syllables(1, 2) + self.pick(("", "a", "e", "en", "ia", "o", "us", "ette", "elle", "ina", "ric", "dric", "ilde", "ora"))).title()

    def last(self) -> str:
        r = self.r.random()
        if r < 0.3:
            name = self.pick(FAMILY)
        elif r < 0.65:
            name = (self.pick((self.syllables(1, 1), self.pick(VOWEL) + self.pick(CODA), self.word()[:6])) + self.pick(SUFFIX)).title()
        else:
            name = self.syllables(1, 3).title()
        if self.chance(0.05):
            name = self.pick(("O'", "O’", "Mc", "Mac", "D'", "Al-", "El ")) + name
        if self.chance(0.1):
            name += "-" + (self.pick(FAMILY) if self.chance(0.5) else (self.syllables(1, 1) + self.pick(SUFFIX)).title())
        return name

    def name(self) -> str:
        first, last = self.first(), self.last()
        if self.chance(0.07):
            last = self.pick(PARTICLES) + " " + last
        if self.chance(0.1):
            first += self.pick((f" {self.pick('ABCDEFGHIJKLMNOPRSTW')}.", "-" + self.first(), " " + self.first()))
        if self.chance(0.12):
            last = last.upper()
        blank = self.pick((" ",) * 18 + ("  ", "\n"))
        if self.chance(0.2):
            return f"{last}, {first}"
        name = f"{first}{blank}{last}"
        return name.upper() if self.chance(0.02) else name

    @staticmethod
    def plain(name: str) -> str:
        return re.sub(r"[^a-z]", "", unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower())

    def email(self) -> str:
        a, b = self.plain(self.first()) or "a", self.plain(self.last()) or "b"
        local = self.pick((f"{a}.{b}", f"{a[0]}{b}", f"{b}_{a}{self.digits(2)}", f"{a}+{self.word()}", f"{a}-{b}", f"{a[0]}.{b}", b + self.digits(2), a, f"{a}_{b}"))
        local = unicodedata.normalize("NFKD", local).encode("ascii", "ignore").decode()
        w = self.plain(self.word()) or "site"
        top = self.pick("com org net de fr es io dev example test invalid local eu co.uk info edu".split())
        domain = self.pick((f"{w}.{top}", f"{w}-{self.plain(self.word())}.{top}", f"mail.{w}.{top}", f"example.{top}"))
        r = self.r.random()
        if r < 0.3:
            at = self.pick((" [at] ", " (at) ", "(at)", "[at]", " at ", " AT ", "{at}", " <at> ", "＠"))
            dot = self.pick((" [dot] ", " (dot) ", " dot ", "[dot]", "(dot)")) if self.chance(0.5) else "."
            return local + at + domain.replace(".", dot)
        out = f"{local}@{domain}"
        if self.chance(0.1):
            return out.upper()
        return ".".join(x.title() for x in out.split(".")) if self.chance(0.06) else out

    def phone(self) -> str:
        """Public national and international forms."""
        d, e = self.digits, lambda: self.r.randint(1, 9)
        sep = self.pick((" ", "-", ".", " "))
        return self.pick((
            f"+1{sep}{e()}{d(2)}{sep}{d(3)}{sep}{d(4)}", f"1 {e()}{d(2)} {d(3)} {d(4)} ext. {d(2)}", f"{e()}{d(2)}{sep}{d(3)}{sep}{d(4)}", f"{e()}{d(2)}.{d(3)}.{d(4)}", f"({e()}{d(2)}) {d(3)}-{d(4)}", f"{e()}{d(2)}-{d(3)}-{d(4)} x{d(3)}",
            f"+44 (0){d(2)} {d(4)} {d(4)}", f"+44 {d(4)} {d(6)}", f"0{d(4)} {d(6)}", f"0{d(4)} {d(6)}", f"0{d(2)} {d(4)} {d(4)}", f"+49 {d(2)} {d(4)} {d(4)}", f"+49 ({e()}{d(2)}) {d(6)}", f"00{e()}{e()}-{d(3)}-{d(7)}", f"0{d(3)} / {d(6)}", f"0{d(3)}/{d(7)}", f"0{d(2)}-{d(7)}",
            f"+33 {e()} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{e()}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}", f"0{e()}{d(8)}", f"+34 {e()}{d(2)} {d(3)} {d(3)}", f"{self.pick('679')}{d(8)}", f"{self.pick('69')}{d(2)} {d(2)} {d(2)} {d(2)}", f"+34 9{d(2)} {d(2)} {d(2)} {d(2)}", f"00{d(2)} {d(3)} {d(3)} {d(3)}", f"+{e()}{d(1)} {d(3)} {d(3)} {d(3)}",
        ))

    def id_number(self) -> str:
        """Public forms of social security, insurance, tax, passport and identity card numbers."""
        d, u = self.digits, lambda: self.pick("ABCDEFGHJKLMNPRSTWXYZ")
        return self.pick((
            f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{u()}{u()} {d(2)} {d(2)} {d(2)} {u()}", f"{u()}{u()}{d(6)}{u()}", f"{u()}{d(2)}{u()}{d(5)}", f"{u()}{d(8)}", f"{u()}{u()}{d(1)}{u()}{d(2)}{u()}{d(2)}", f"{u()}{u()}{d(7)}",
            f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), d(9), f"{self.pick('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{self.pick('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}", f"{self.pick('12')}{d(14)}", f"{self.pick('12')}{d(12)}",
            f"{d(8)}{u()}", f"{d(8)}-{u()}", f"{self.pick('XYZ')}{d(7)}{u()}", f"{self.pick('XYZ')}-{d(7)}-{u()}", f"{d(2)}.{d(3)}.{d(3)}-{u()}", f"{d(2)}/{d(3)}/{d(5)}",
        ))

    def street_word(self) -> str:
        return self.pick((self.word().title(), self.last(), self.pick(("Station", "Church", "Park", "Mill", "Castle", "Garden", "Lake", "Market", "High"))))

    def address(self) -> str:
        """Street and box forms of four countries."""
        n, place, s, zip5, r = self.r.randint(1, 250), self.last().replace("\n", " "), self.street_word(), self.digits(5), self.r
        if self.chance(0.2):
            s = f"{self.pick(('Old', 'New', 'Upper', 'North', 'West', 'St.'))} {s}"
        if self.chance(0.2):
            place += self.pick(("-sur-Mer", "-les-Bains", " am See", " del Río", " Bay", "-le-Vieux", " an der Aue"))
        letter = self.pick(("", "", "", "a", "b", "A", "B"))
        kind = self.pick("Road Rd Lane Ave Close Terrace Blvd. Blvd Street St St. Drive Way Court Avenue Crescent Place Square Ln Dr".split())
        stem = self.street_word()
        german = self.pick((stem + self.pick(("weg", "gasse", "straße", "str.", "allee", "platz", "ring", "strasse")), f"{self.pick(('Am', 'An der', 'Im', 'Zum', 'Alte', 'Auf dem', 'Unter den', 'In der'))} {stem}" + self.pick(("", "", "straße", "n"))))
        french = f"{self.pick(('rue', 'avenue', 'impasse', 'place', 'chemin', 'boulevard', 'quai', 'allée', 'route', 'Rue'))} {self.pick(('de la ', 'des ', 'du ', 'de l’', 'de ', '', 'd’', chr(39).join(('de l', ''))))}{stem}"
        spanish = f"{self.pick(('Calle', 'Plaza', 'Avda.', 'Avenida', 'Paseo', 'Camino', 'C/', 'Ronda', 'Travesía'))} {self.pick(('de la ', 'del ', 'de ', '', 'de los '))}{stem}"
        unit = self.pick((f"Apt {r.randint(1, 60)}", f"Apt. {r.randint(1, 60)}", f"Flat {r.randint(1, 30)}", f"Suite {r.randint(1, 400)}", f"Unit {r.randint(1, 30)}", f"#{r.randint(1, 40)}"))
        comma = self.pick((", ", ", ", ", ", "\n"))
        return self.pick((
            f"{n} {s} {kind}{comma}{place}", f"{n}{letter} {s} {kind}, {unit}{comma}{place} {zip5}", f"{unit}, {n} {s} {kind}{comma}{place}", f"{n} {s} {kind}", f"{n} {s} {kind}, {place} {zip5}",
            f"{self.pick(('P.O. Box', 'PO Box', 'Box'))} {self.digits(r.randint(2, 4))}, {place}", f"{german} {n}{letter}{comma}{zip5} {place}", f"{german} {n}{letter}, {place}", f"Postfach {self.digits(r.randint(2, 5))}, {zip5} {place}", f"{german} {n}{letter}",
            f"{n} {french}{comma}{zip5} {place}", f"{n}, {french} à {place}", f"{n} {self.pick(('bis', 'ter'))}, {french}, {place}", f"{n}, {french}, {zip5} {place}", f"BP {self.digits(3)}, {zip5} {place}",
            f"{spanish} {n}, {place}", f"{spanish}, {n}, {place}", f"{spanish} {n}, {r.randint(1, 8)}.º {self.pick('ABCD')}, {zip5} {place}", f"{spanish} {n}{comma}{zip5} {place}", f"Apartado {self.digits(r.randint(2, 4))}, {zip5} {place}",
        ))

    def sentence(self, low: int = 2, high: int = 9) -> str:
        language = self.pick(("en", "en", "en", "de", "fr", "es"))
        common = WORDS[language]
        out = []
        for _ in range(self.r.randint(low, high)):
            r = self.r.random()
            if r < 0.5:
                out.append(self.pick(common))
            elif r < 0.85:
                w = self.word()
                out.append(w.title() if language == "de" and self.chance(0.4) else w)
            else:
                out.append(self.pick((self.ident, self.number, self.path))())
        text = " ".join(out)
        return text[:1].upper() + text[1:] if self.chance(0.7) else text

    def path(self) -> str:
        return "/".join(self.word() for _ in range(self.r.randint(1, 3))) + self.pick((".py", ".ts", ".go", ".java", ".yaml", ".js", ".md", ""))

    def value_line(self) -> list:
        """A value with what is around it, as parts: text, or (kind, text)."""
        kind = self.pick(self.kinds)
        value = (kind, getattr(self, kind)())
        cue, form = self.pick(CUES[kind]), self.r.random()
        if self.chance(0.3):
            cue = self.pick((cue.title(), cue.upper(), cue.capitalize()))
        if form < 0.10:
            after = self.pick(AFTER.get(kind, AFTER["other"]))
            return [self.pick(("", "", "- ", "The ", "> ")) if kind != "name" else self.pick(("", "", "- ", "> ")), value, " " + after + self.pick((".", "", " " + self.sentence(1, 5)))]
        if form < 0.38:
            before = self.pick(LEADS[kind])
            r = self.r.random()
            before = before[:1].upper() + before[1:] if r < 0.45 else f"{self.sentence(1, 6)} {before}" if r < 0.8 else before
            after = self.pick((".", ",", "", "?", ";", "\n", " " + self.pick(AFTER.get(kind, AFTER["other"])), " " + self.sentence(1, 5), ")", "."))
            opening = self.pick(("", "", "", "", "", "<", "(", "'", '"')) if kind != "address" else ""
            closing = {"<": ">", "(": ")"}.get(opening, opening)
            return [before + self.pick((" ", " ", " ", ": ")) + opening, value, closing + after]
        if form < 0.62:
            joint = self.pick((": ", ": ", ":", " = ", "=", " : ", " - ", "\t", ": \"", "='", '": "', "': '", " is ", " | ", "=\""))
            closing = joint[-1] if joint[-1] in "\"'" else ""
            opening = '"' if joint == '": "' else "'" if joint == "': '" else self.pick(("", "", "", "@", "| ", "- ", "# ", "// ", "* ", "  "))
            return [opening + cue + joint, value, closing + self.pick(("", "", ",", ";", " |", "}", "\n", "."))]
        if form < 0.72:
            call = self.pick((self.ident() + '("', self.ident() + ' = "', self.ident() + ": '", "<td>", f"<{cue}>".replace(" ", "_"), self.number() + ",", self.number() + ";", "[", '["', f"INFO {self.ident()} "))
            return [call, value, self.pick(('"', "'", "</td>", ",", ";", '", ' + self.number(), "]", "", '")'))]
        if form < 0.80:
            return [self.pick(("", "", "  ", "- ", "* ", "> ")), value, self.pick(("", "", "\n", ".", ",", ":"))]
        if form < 0.90 or kind == "name" and form < 0.95:
            first, last = self.first(), self.last()
            mail = ("email", f"{(self.plain(first) or 'a')[:1]}.{self.plain(last) or 'b'}@{self.word()}.{self.pick(('org', 'example', 'net', 'com'))}")
            return self.pick((
                [self.pick(("Signed-off-by: ", "Author: ", "From: ", "Co-authored-by: ", "To: ", "")), ("name", f"{first} {last}"), " <", mail, ">"],
                [self.pick(("From: ", "Cc: ", "")) + '"', ("name", f"{last}, {first}"), '" <', mail, ">"],
                [f"{self.number()},", ("name", f"{first},{last}"), ",", mail, f",{self.number()}"], [f"{self.number()};", ("name", f"{first};{last}"), ";", mail, ";"],
                ["| ", ("name", f"{first} {last}"), " | ", mail, " |"], ["", ("name", f"{first} {last}"), self.pick((", ", " | ", "; ", "\n")), ("phone", self.phone()), ""],
                ["", ("name", f"{first} {last}"), self.pick(("\n", ", ")), ("address", self.address()), "\n"], [self.pick(LEADS["name"]) + " ", ("name", f"{first} {last}"), self.pick((" and ", " und ", " et ", " y ", ", ")), ("name", f"{self.first()} {self.last()}"), " "],
            ))
        return [self.pick(CLOSING) + "\n", ("name", self.name().replace("\n", " ")), self.pick(("\n", "", "\n\n"))]

    def other(self) -> str:
        """Text without a person: prose, code, numbers and names of things."""
        d, w, n, i = self.digits, self.word, self.number, self.ident
        r = self.r.random()
        if r < 0.22:
            return self.sentence(3, 12) + self.pick((".", ".", "", ":", "?", "!"))
        if r < 0.36:
            at = self.r.randrange(len(self.prose) - 200)
            return self.prose[at : at + self.r.randint(30, 160)]
        if r < 0.50:
            title = " ".join(self.pick((w().title(), w().title(), w(), self.pick(WORDS["en"]).title())) for _ in range(self.r.randint(2, 4)))
            return self.pick(("", "", "# ", "## ", "The ", "A ", "New ", "- ", "In ", "class ", "Die ", "Le ", "El ")) + title + self.pick(("", ".", " " + n(), " class", ": " + n(), " " + w(), f" {n()} {w().title()}"))
        if r < 0.56:
            # a number or a small word before a capitalised noun is neither an address nor a name
            words = [self.pick(WORDS["de"]), self.pick(WORDS["de"]), self.pick((n(), n(), d(2), self.pick(("der", "die", "das", "ein", "den")))), w().title(), self.pick(WORDS["de"])]
            return self.pick((" ".join(words), " ".join(words[:4]) + ".", f"{words[0].title()} {' '.join(words[2:])}", f"{words[2]} {words[3]}"))
        hexa = "".join(self.r.choices("0123456789abcdef", k=self.pick((7, 8, 16, 32, 40))))
        when = f"{self.pick(('2019', '2021', '2023', '2024', '1999'))}-{self.r.randint(1, 12):02}-{self.r.randint(1, 28):02}"
        return self.pick((
            f"{i()} = {i()}({n()})", f"def {i()}({w()}, {w()}):", f"return {i()}.{w()}({i()})", f"if ({i()} < {n()}) {{", f"public {i()} {i()}({i()} {w()}) {{", f"import {w()}.{w()}.{i()};", f"from {w()}.{w()} import {i()}", f"const {w()} = {i()}[{n()}];", f"for {w()} in {i()}:", f'    "{i()}": {n()},', f"- {i()}: {w()} {w()}",
            f'log.{w()}("{w()} {w()} %s", {i()})', f"SELECT {w()}, {w()} FROM {i()} WHERE {w()} = {n()};", f"INSERT INTO {i()} VALUES ({n()}, '{i()}', {n()});", f"<{w()} {w()}=\"{n()}\">{w()}</{w()}>", f"@{i()}", f"@{w()}_{w()} {self.pick(('and', 'or'))} @{w()}", f"private final {i()} {i()};", f"throw new {i()}(\"{self.sentence(2, 5)}\");",
            f"{w()}@{d(1)}.{n()}.{n()}", f"pinned to {w()}@{d(1)}.{d(2)}.{d(2)} {w()}", f"{self.pick(('git', 'hg', 'deploy'))}@{w()}.{w()}.{self.pick(('com', 'org', 'example'))}:{w()}/{w()}.git", f"ssh://git@{w()}.{self.pick(('example', 'org'))}/{w()}.git", f"npm install @{w()}/{w()}@{d(1)}.{d(2)}.{d(1)}", f"https://{w()}.{w()}.{self.pick(('com', 'org', 'io'))}/{w()}?{w()}={n()}", f"//{w()}@{d(1)}.{d(1)}",
            f"{hexa[:8]}-{d(4)}-4{d(3)}-9{d(3)}-{d(12)}", f"commit {hexa}", f"0x{hexa[:12]}", f"checksum {hexa}", f"sha256:{hexa}", f"10.{d(1)}.{d(2)}.{d(3)}:{d(4)}", f"192.168.{d(1)}.{d(2)}", f"{when}T1{d(1)}:2{d(1)}:3{d(1)}Z {self.pick(('INFO', 'WARN', 'DEBUG', 'ERROR'))} {i()} {w()}={n()}", f"{when} {w()} {w()}", f"v{d(1)}.{d(2)}.{d(1)}", f"version {d(1)}.{d(2)}.{d(2)}-{hexa[:7]}", f"## {d(1)}.{d(2)}.{d(1)} - {when}",
            f"{n()} {w()} {n()} {w()}", f"{d(3)} {d(3)} {d(3)} {d(3)} {w()}", f"{w()}: {d(3)} {d(2)} {d(2)} {d(3)}", f"[{n()}, {n()}, {n()}, {n()}]", f"| {w()} | {n()} | {n()} |", f"{w()} {d(4)}-{d(4)} {w()}", f"{w().title()}-{d(4)}", f"{w().upper()}-{n()}", f"{d(1)}.{d(4)} {self.pick(('s', 'ms', 'MB', 'GB', '%', 'rows'))}", f"{n()} of {n()} {w()}", f"from {d(1)}.{d(3)} to {d(2)}.{d(3)} {w()}", d(self.pick((12, 15, 20, 30))), f"{w()} {d(8)}", f"{w()} {d(6)}", f"build {d(8)}-{d(4)}", f"{d(4)} x {d(4)}", f"{i()} += {d(3)} * {i()}", f"section {n()}.{n()}.{n()}", f"{w()} {d(7)} {w()}", f"RFC {d(4)}", f"{i()}:{n()}: {self.sentence(2, 5)}", f'  File "{self.path()}", line {n()}, in {i()}', f"at {w()}.{w()}.{i()}({i()}.java:{n()})", f"{w().title()} {n()}, {w().title()} {n()}", f"{n()} {w().title()} {self.pick(('files', 'rows', 'branches'))}, {n()} {w()}", f"error {d(3)}: {d(6)} {w()}",
            f"{self.pick(WORDS['de']).title()} {self.pick(WORDS['de'])} {w().title()} {self.pick(WORDS['de'])} {w().title()}", f"{w().title()}, {w().title()}", f"{w().title()}: {w().title()}", f"{i()} {i()} {i()}", f"({i()}, {i()})", f"{w().title()} & {w().title()}", f"{self.pick(('January', 'March', 'Monday', 'Montag', 'Lundi', 'Martes'))} {d(2)}, {d(4)}", f"{self.pick(('Apache', 'Open', 'Visual', 'Google', 'Linux', 'Windows'))} {w().title()} {d(1)}.{d(1)}",
        ))

    def example(self) -> tuple[np.ndarray, np.ndarray]:
        parts: list = []
        for k in range(self.r.randint(2, 5)):
            if k:
                parts.append(self.pick(("\n", "\n", " ", "\r\n", "\n\n", "  ", ". ")))
            if self.chance(0.42):
                parts.extend(self.value_line())
            else:
                parts.append(self.other())
        text, tags = "", []
        for part in parts:
            if isinstance(part, str):
                text += part
                tags += [0] * len(part)
            else:
                kind, value = part
                at = 1 + 2 * KINDS.index(kind)
                text += value
                tags += [at] + [at + 1] * (len(value) - 1)
        # windows also begin in the middle of a word, and at any place of a frame
        low = self.r.randint(-FRAME, max(0, len(text) - LENGTH))
        low = max(low, 0)
        ids = np.zeros(LENGTH, np.uint8)
        out = np.zeros(LENGTH, np.int64)
        part = encode(text[low : low + LENGTH])
        ids[: len(part)] = part
        out[: len(part)] = tags[low : low + LENGTH]
        return ids, out


def batch(maker: Maker, size: int) -> tuple[np.ndarray, np.ndarray]:
    rows = [maker.example() for _ in range(size)]
    return np.stack([x for x, _ in rows]), np.stack([y for _, y in rows])


def train(p: dict, maker: Maker, batches: int, rate: float, size: int = 128) -> dict:
    adam = Adam(p, rate)
    for k in range(batches):
        loss, g = loss_and_gradient(p, *batch(maker, size))
        adam.step(p, g, rate * (1 - k / batches) + 5e-5)
        if k % 200 == 0:
            ids, tags = batch(Maker(10_000 + k), 256)
            found = viterbi(p, emissions(p, ids)).T
            inside = tags > 0
            print(k, round(loss, 2), "accuracy", round(float((found == tags).mean()), 4), "inside", round(float((found == tags)[inside].mean()), 4), flush=True)
    return p


def pruned(p: dict, maker: Maker, hidden: int) -> dict:
    """The network with only those units of each direction that move the emissions most."""
    ids, _ = batch(maker, 256)
    n, frame = p["bf"].shape[0] // 4, p["near"].shape[0] // p["embed"].shape[1]
    wide, out = p["near"].shape[0], {k: v for k, v in p.items() if k not in ("out", "wf", "wb", "bf", "bb")}
    rows = []
    for d, own in (("f", p["out"][:n]), ("b", p["out"][n:])):
        cache: list = []
        emit = np.zeros((ids.shape[1] // frame, len(ids), p["bias"].shape[0]), np.float32)
        _run(p, d, ids, emit, cache)
        spread = np.concatenate([squashed * z[:, 2 * n : 3 * n] for _, _, _, z, squashed in cache]).std(0)
        kept = np.sort(np.argsort(-spread * np.sqrt((own**2).sum(1)))[:hidden])
        gates = np.concatenate([k * n + kept for k in range(4)])
        out[f"w{d}"] = p[f"w{d}"][np.concatenate([np.arange(wide), wide + kept])][:, gates]
        out[f"b{d}"] = p[f"b{d}"][gates]
        rows.append(own[kept])
    return out | {"out": np.concatenate(rows)}


#: Legs of the training: seed and share of names of the maker, batches, rate; before the third, units are taken out.
LEGS = [(7, 1, 10_000, 5e-3), (8, 4, 5_000, 2e-3), (9, 3, 5_000, 2.5e-3), (10, 3, 6_000, 2e-3)]


if __name__ == "__main__":
    # OUT.npz, and to go on from a leg: its result, and how many legs are done
    p = dict(np.load(sys.argv[2])) if len(sys.argv) > 2 else start(7, hidden=WIDE)
    done = int(sys.argv[3]) if len(sys.argv) > 3 else 0
    for k, (seed, names, batches, rate) in enumerate(LEGS[done:], done):
        if k == 2:
            p = pruned(p, Maker(9), HIDDEN)
        p = train(p, Maker(seed, names), batches, rate)
        np.savez_compressed(sys.argv[1], **{k: v.astype(np.float32) for k, v in p.items()})
