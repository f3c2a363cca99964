"""Sentences and items from which training text for the tagger of personal data is made: names, numbers and addresses of many
shapes in frames of four languages, beside things that look like them."""

from __future__ import annotations

import random

from . import pii_rules as rules

GIVEN = """James John Robert Michael David William Mary Linda Susan Sarah Karen Emma Olivia Daniel Thomas George Henry Alice Grace
Victor Colin Stuart Gordon Hannah Ellen Wendy Fiona Ivy Mei Kwame Zainab Priya Leroy Omar Fatima Chen Ravi Sven Lars Anna Peter
Wolfgang Jürgen Dieter Matthias Björn Lukas Torsten Sabine Silke Ursula Gudrun Annika Heike Petra Klaus Uwe Günter Hans Ingrid Stefan
Yves Luc Benoît Thierry Fabrice Gérard Loïc Camille Noémie Inès Maëlle Élodie Solène Amélie Chloé Jean Pierre Marie Sophie Julien
Emilio Joaquín Sergio Andrés Álvaro Iñigo Begoña Belén Lucía Nuria Rocío Carmen Beatriz Javier Pablo Diego Marta Elena José Luis
Olga Ivan Dmitri Natasha Katarzyna Piotr Agnieszka Zoltán Giulia Marco Francesca Luca Ingeborg Kaisa Mikko Aino Nikos Eleni Yusuf Ayşe
Mehmet Amina Tariq Leila Anjali Arjun Deepa Haruto Yuki Sakura Minh Linh Jisoo Thabo Chidi Ngozi Adaeze Kofi Abena Joaquim Tiago""".split()
#: Beginnings and ends that make surnames, by style.
SURNAMES = [
    ("Thorn Wend Quill Mar Ash Hol Vel Kes Pen Bram Hart West Brook Fair Black Win Hather Stan Ald Rad Sher Den Thur Cald".split(), "gate drake dale wick ley by stead field combe mere low worth ton man son wood ford well bury shaw".split()),
    ("Linden Wolken Stein Ober Krumm Grün Hasel Schwarz Berg Kohl Lang Roth Weiß Eich Zimmer Neu Alt Feld Brand Kirch Vogel".split(), "mann müller hofer bruch acker rath brecht bach stein meier bauer ner schmidt wald berger huber".split()),
    ("Mont Beau Roch Duch Lafon Val Clair Dur Mar Per Gar Lav Bern Char Dela Fontval Bouch Lem Giraud Mor".split(), "rieux gnon clair nac tier mont ard eau et in aud oux ot ier and elle".split()),
    ("Cerra Robl Valver Quint Zald Monte Her Gonz Mart Fern Alv San Ram Cast Del Ort Nav Vill Gu Med".split(), "illo dero verde anza ez ero ado ares ueta ales ínez ina eda osa edo era".split()),
    ("Kowal Nov Petr Iv Zelen Vol Mor Pavl Sid Kuz Hor Dvor Jank Wis Lewand Pol".split(), "ski ska ov ova enko ak ák ik owicz čić ić in ina ev eva".split()),
    ("Papa Kara Dimitr Niko Geor Stav Theo Chrys Mavro Yan".split(), "dopoulos iou akis idis oglou pulos atos antis".split()),
    ("Ade Oko Olu Nwo Chukw Bal Ebe Ik Ogun Ama".split(), "bayo ye wale su gun ogun ola emeka uche nkwo ma tunde".split()),
    ("Sha Pat Mehr Gup Red Ban Chat Kul Iy Nai Des".split(), "rma el otra ta dy erjee karni er r ai wal".split()),
    ("Tana Yama Suzu Wata Naka Koba Mori Saka".split(), "ka moto ki nabe mura yashi ta da guchi".split()),
    ("Ros Berg Lind Nys Hag Sand Holm Ek Dahl Vest".split(), "sen son ström qvist gren lund berg dal by nes".split()),
    ("Ross Bian Mar Ferr Rom Gal Cont Man Esp Ricc".split(), "i chi ini ano ari oni etti elli osito ucci".split()),
    ("Yıl Kay De Öz Ars Çel Ko Er".split(), "maz a mir türk lan ik ç doğan".split()),
]
TITLES = "Mr Mrs Ms Miss Dr. Dr Prof. Herr Herrn Frau Monsieur Madame Mademoiselle Mme M. Don Doña Señor Señora Sra. Sr. Sir".split()
#: Frames of names; {n} is the name. Tests use other frames.
NAME_FRAMES = {
    "en": """Hi {n}, |Hello {n}, |Dear {n}, |Dear {n}:|Thanks, {n}|Regards, {n}|Signed, {n}|Best wishes, {n}|My name is {n} and I |I am {n} from |I'm {n}, the |This is {n} speaking|
    Please call {n} before |Please forward this to {n} today|Ask {n} about |Contact: {n}|contact {n} for details|assigned to {n}|assignee={n}|owner: {n}|Reviewed by {n} on |cc {n}, who |spoke with {n} yesterday|
    {n} approved |{n} said that |{n} has left |{n} will join |{n}, who runs |{n} wrote: |a letter from {n} arrived|a reply to {n}.|the account of {n} was |belongs to {n}, not |filed by {n} last week|reported by {n}.|
    interview with {n} about |In the meeting {n} said |paragraph about {n} from |photo of {n} taken|born as {n} in |the patient {n} was |our customer {n} wants|employee: {n};|name: {n}\n|Author: {n}\n|for {n} and her |"{n}" <|({n}) |
    according to {n}, the |met {n} at the |invited {n} to |{n}'s laptop |sent by {n} at |on behalf of {n}, I|the tenant {n} moved|Attn: {n}|husband of {n}, |{n} lives in |{n} (born 19|by {n}""",
    "de": """Hallo {n}, |Liebe {n}, |Lieber {n}, |Sehr geehrter {n}, |Mein Name ist {n} und |Ich heiße {n} und |Ich bin {n}, |Gezeichnet {n}|Mit freundlichen Grüßen {n}|Viele Grüße {n}|Laut {n} war |Nach Aussage von {n} ist |
    Bitte {n} anrufen|eine Antwort an {n}.|Beschwerde kam von {n}.|ein Brief von {n} |{n} hat die |{n} sagte, |{n} wohnt in |{n} arbeitet |Ansprechpartner: {n}|zuständig ist {n}, |unsere Kundin {n} möchte|der Patient {n} wurde|
    im Gespräch mit {n} |das Konto von {n} |genehmigt durch {n} am |Verfasser: {n}\n|vertreten durch {n}, |für {n} und |geprüft: {n}|Unterschrift {n}""",
    "fr": """Bonjour {n}, |Cher {n}, |Chère {n}, |Je m’appelle {n} et |Je suis {n}, |Signé : {n}|Cordialement, {n}|Bien à vous, {n}|Selon {n}, le |D’après {n}, |une réponse à {n}.|plainte vient de {n}.|une lettre de {n} |
    {n} a validé |{n} a dit que |{n} habite à |{n} travaille |Appelez {n} avant |le compte de {n} |le dossier de {n} |transmis par {n} hier|notre cliente {n} souhaite|le patient {n} a |auteur : {n}\n|responsable : {n};|avec {n} et |
    l’entretien avec {n} |au nom de {n}, |pour {n}, qui |invité {n} à""",
    "es": """Hola {n}, |Estimado {n}: |Estimada {n}, |Me llamo {n} y |Soy {n}, |Mi nombre es {n} y |Firmado: {n}|Atentamente, {n}|Saludos, {n}|Según {n}, el |De acuerdo con {n}, |respuesta para {n}.|queja la presentó {n}.|
    una carta de {n} |{n} aprobó |{n} dijo que |{n} vive en |{n} trabaja |Llame a {n} antes|la cuenta de {n} |el expediente de {n} |enviado por {n} ayer|nuestra clienta {n} quiere|el paciente {n} fue|autor: {n}\n|responsable: {n};|
    con {n} y |la reunión con {n} |en nombre de {n}, |para {n}, que |invitó a {n} a""",
}
ITEM_FRAMES = {
    "email": "Write to {x}.|e-mail: {x}|mail {x} for help|Contact : {x}|{x} |reply-to {x},|Schreib an {x} bitte|écrivez à {x} avant|escribe a {x} cuanto antes|<{x}>|user={x};|my address is {x} and|({x})|login {x}\n".split("|"),
    "phone": "call {x} after|Tel. {x}|phone: {x}|ring {x} today|mobile {x},|Rückruf unter {x} bitte|unter {x} erreichbar|appelez le {x} avant|au {x}.|llame al {x} antes|teléfono {x}|tel:{x}|({x}) |fax {x}\n".split("|"),
    "id_number": "SSN {x} was|my number is {x}.|passport no. {x}|NI number {x},|Steuer-ID {x} |Ausweisnummer {x}|DNI {x} sin|NIE {x},|numéro de sécurité sociale {x} en|pasaporte {x}|id: {x};|({x})|{x} was printed|Nummer {x} steht".split("|"),
    "address": "I live at {x}.|deliver to {x} please|moved to {x} in|address: {x}|Ich wohne {x} und|Lieferung an {x}, bitte|J’habite {x}, |livrer au {x}|Vivo en {x} y|enviar a {x}.|({x})|{x}\n|parcel for {x} came".split("|"),
}
_NOT = """Maple Street cluster|port {d}{d}{d}{d} on {W} Street cluster|Jenkins and Victoria Metrics|Apache Kafka|Grafana Loki|Spring Boot|Visual Studio Code|Amazon Web Services|Baker notation, page {d}{d}|the Review Board|Security Team|Monday morning|New Zealand|
build {d}{d}{d}-{d}{d}-{d}{d}{d}{d} failed|number {d}{d}{d}{d}-{d}{d}-{d}{d}{d} is out of stock|INV-20{d}{d}-{d}{d}{d}{d}{d}{d}|version {d}.{d}{d}.{d}|from 10.{d}.{d}{d}{d}.{d}{d}|192.0.2.{d}{d} answered|20{d}{d}-0{d}-1{d} took {d}{d}{d}{d}{d}{d}{d} milliseconds|
ticket GW-{d}{d}{d}{d}{d}{d}KK|part number {d}{d}{d}{d}{d}-{d}|checksum {d}f{d}{d}c0ffee{d}|@app.route("/v{d}")|Install @acme/ui-kit@{d}{d}.{d}|git@example.org:repo|Die Charge {d}{d}-{d}{d}-{d}{d} wurde verworfen|Der Lauf {d}{d}{d}{d}-{d}{d}-{d}{d}{d} ist fehlgeschlagen|
Lote {d}{d}-{d}{d}-{d}{d} falló|Artikel {d}{d} der Richtlinie|article {d}{d} du règlement|Bitte erkläre den Satz|Hallo zusammen, der Lauf|Dear Team, the|Hi all, the|Liebe Grüße vom Team|Bonjour à tous, le|Hola equipo, la|Sehr geehrte Damen und Herren|Please call the Help Desk|
according to Release Notes, the|Contact: Service Desk|owner: Platform Team|assigned to Data Platform|approved by the Audit Committee|{W} {W2} Framework|{W} Pipeline|Python and Java|Windows Server 20{d}{d}|{W} Road cluster|Berlin Mitte|Port {d}{d}{d}{d}|San Francisco|Buenos Aires|Saint-Oriel|
Bad Lindern|Le Monde|Black Friday|General Terms|Pull Request|Kubernetes Ingress|Prometheus Alertmanager|Log4j Shell|room {d}{d}{d}|line {d}{d}{d}{d}, column {d}{d}|flight {d}{d}{d}{d}|seed={d}{d}{d}{d}{d}{d}{d}{d}|0x{d}{d}{d}f|{d}{d}{d}{d}{d}{d}{d} rows|{d}{d}:{d}{d}:{d}{d}|
Project {W}|{W} Service|the {W} Gateway|{W} {W2} Inc.|Universal Windows Platform|Quality Gate|Die Freigabegruppe|Unser Prüfdienst|das Berichtswesen|Le contrôle d’entrée|El equipo de políticas""".replace("\n", "").split("|")
_W = "Orion Atlas Nimbus Falcon Delta Aurora Vertex Quartz Ember Cobalt Harbor Cedar Maple Linden Summit Beacon Pioneer Horizon".split()
_DOMAINS = "example.com example.org example.net mail.example.com firma.example web.test acme.example post.example.de correo.example.es".split()


def surname(r: random.Random) -> str:
    head, tail = r.choice(SURNAMES)
    s = r.choice(head) + r.choice(tail)
    if r.random() < 0.1:
        s = r.choice(("Mc", "O’", "Mac", "De", "Di", "Van ", "von ", "de la ", "El-", "bin ")) + s
    if r.random() < 0.1:
        head, tail = r.choice(SURNAMES)
        s += "-" + r.choice(head) + r.choice(tail)
    return s


def given(r: random.Random) -> str:
    if r.random() < 0.75:
        return r.choice(GIVEN)
    c, v = "b d f g h j k l m n p r s t v z ch sh th br kr".split(), "a e i o u ai ia".split()
    return "".join(r.choice(c) + r.choice(v) for _ in range(r.choice((1, 2, 2, 3)))).capitalize() + r.choice(("", "n", "s", "l", "m", "r", ""))


def name(r: random.Random) -> str:
    first, last = given(r), surname(r)
    k = r.random()
    if k < 0.14:
        return r.choice(TITLES) + " " + last
    if k < 0.18:
        return r.choice(("Herrn Dr. ", "Prof. Dr. ", "Dr. ", "Frau Dr. ")) + (first + " " if r.random() < 0.5 else "") + last
    if k < 0.27:
        return f"{last}, {first}"
    if k < 0.42:
        return f"{first} {r.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ')}. {last}"
    if k < 0.50:
        return f"{first} {last.upper()}"
    if k < 0.62:
        return f"{first} {last}".lower()
    if k < 0.66:
        return f"{last} {first}"
    if k < 0.72:
        return f"{first} {given(r)} {last}"
    if k < 0.75:
        return f"{first.upper()} {last.upper()}"
    return f"{first} {last}"


def _fill(r: random.Random, form: str) -> str:
    out = form.replace("{W2}", r.choice(_W)).replace("{W}", r.choice(_W))
    while "{d}" in out:
        out = out.replace("{d}", r.choice("0123456789"), 1)
    return out


def email(r: random.Random) -> str:
    user = r.choice((lambda: given(r) + "." + surname(r), lambda: surname(r), lambda: given(r)[0] + surname(r), lambda: given(r) + "_" + surname(r), lambda: given(r) + _fill(r, "{d}{d}"), lambda: surname(r) + "+" + r.choice(("test", "news", "work"))))()
    user = user.replace(" ", "").replace("’", "")
    if r.random() < 0.85:
        user = user.lower()
    domain = r.choice(_DOMAINS) if r.random() < 0.5 else surname(r).lower().replace(" ", "").replace("’", "") + "." + r.choice("com org net de fr es io example test co.uk".split())
    at = r.choice(("@",) * 6 + (" at ", " [at] ", "(at)", "[at]", " arroba ", " (at) ", " arobase "))
    if at != "@" and r.random() < 0.7:
        domain = domain.replace(".", {" arroba ": " punto ", " arobase ": " point "}.get(at, r.choice((" dot ", "[dot]", "(dot)", " [dot] "))))
    out = user + at + domain
    return out.upper() if r.random() < 0.04 else out


PHONES = """+{d}{d} {d}{d} {d}{d}{d}{d} {d}{d}{d}{d}|+1 {n}{d}{d} {n}{d}{d} {d}{d}{d}{d}|+1-{n}{d}{d}-{n}{d}{d}-{d}{d}{d}{d}|({n}{d}{d}) {n}{d}{d}-{d}{d}{d}{d}|{n}{d}{d}-{n}{d}{d}-{d}{d}{d}{d}|{n}{d}{d}.{n}{d}{d}.{d}{d}{d}{d}|+44 20 {d}{d}{d}{d} {d}{d}{d}{d}|+44 7{d}{d}{d} {d}{d}{d}{d}{d}{d}|020 {d}{d}{d}{d} {d}{d}{d}{d}|
+49 {n}{d} {d}{d}{d}{d}{d}{d}{d}|+49 (0){n}{d} {d}{d}{d}{d}{d}{d}|0{n}{d}/{d}{d}{d}{d}{d}{d}{d}|0{n}{d}{d} {d}{d}{d}{d}{d}{d}{d}|0049 {n}{d} {d}{d}{d}{d}{d}{d}|0{n}{d}{d}-{d}{d}{d}{d}{d}{d}{d}|+33 {n} {d}{d} {d}{d} {d}{d} {d}{d}|0{n} {d}{d} {d}{d} {d}{d} {d}{d}|0{n}.{d}{d}.{d}{d}.{d}{d}.{d}{d}|0033 {n} {d}{d} {d}{d} {d}{d} {d}{d}|
+34 6{d}{d} {d}{d}{d} {d}{d}{d}|6{d}{d} {d}{d}{d} {d}{d}{d}|9{d}{d} {d}{d} {d}{d} {d}{d}|+34 9{d} {d}{d}{d} {d}{d} {d}{d}|6{d}{d}-{d}{d}{d}-{d}{d}{d}|(0{n}{d}) {d}{d}{d}{d}{d}{d}|(0{n}{d}{d}) {d}{d}{d} {d}{d}{d}{d}|{n}{d}{d}-{n}{d}{d}-{d}{d}{d}{d} ext. {d}{d}""".replace("\n", "").split("|")
IDS = """{d}{d}{d}-{d}{d}-{d}{d}{d}{d}|{d}{d}{d}-{d}{d}-{d}{d}{d}{d}|AB {d}{d} {d}{d} {d}{d} C|JK{d}{d}{d}{d}{d}{d}A|QQ {d}{d} {d}{d} {d}{d} B|{d}{d}{d}{d}{d}{d}{d}{d}{L}|{d}{d}{d}{d}{d}{d}{d}{d}-{L}|{d}{d}.{d}{d}{d}.{d}{d}{d}-{L}|X{d}{d}{d}{d}{d}{d}{d}{L}|Y-{d}{d}{d}{d}{d}{d}{d}-{L}|
1 {d}{d} 0{n} {d}{d} {d}{d}{d} {d}{d}{d} {d}{d}|2{d}{d}0{n}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}|{d}{d} {d}{d}{d} {d}{d}{d} {d}{d}{d}|L{d}{d}X{d}{d}T{d}{d}|LZ{d}FK{d}{d}{d}T|passport no. {d}{d}{d}{d}{d}{d}{d}{d}{d}|NIE X{d}{d}{d}{d}{d}{d}{d}{L}|DNI {d}{d}{d}{d}{d}{d}{d}{d}{L}|Ausweisnummer L{d}{d}{d}{d}{d}{d}{d}{d}|pasaporte {L}{L}{L}{d}{d}{d}{d}{d}{d}""".replace("\n", "").split("|")


def _digits(r: random.Random, form: str) -> str:
    return "".join(out) if (out := [r.choice("0123456789") if p == "{d}" else r.choice("23456789") if p == "{n}" else r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") if p == "{L}" else p for p in rules.re.split(r"(\{[dnL]\})", form)]) else ""


def phone(r: random.Random) -> str:
    return _digits(r, r.choice(PHONES))


def id_number(r: random.Random) -> str:
    return _digits(r, r.choice(IDS))


def address(r: random.Random) -> str:
    n = str(r.randrange(1, 220)) + (r.choice("abc") if r.random() < 0.15 else "")
    word = surname(r).split("-")[0].replace("’", "") if r.random() < 0.6 else r.choice(_W)
    word = word[:1].upper() + word[1:]
    k = r.random()
    if k < 0.28:
        return r.choice(("", "", "", "Flat 3, ", "Apt 12, ")) + f"{n} {word} {r.choice('Street St Lane Road Rd Avenue Ave Close Court Drive Way Place Terrace Boulevard Crescent'.split())}"
    if k < 0.55:
        if r.random() < 0.6:
            return f"{word}{r.choice('straße strasse weg gasse platz allee ufer damm ring str. steig'.split())} {n}"
        return f"{r.choice(('Am', 'An der', 'Im', 'Zum', 'Zur', 'Auf der', 'Unter den', 'Hinterm', 'Hinter der', 'Vor dem', 'Beim'))} {r.choice('Markt Deich Bach Hang Linden Brücke Kirchhof Tor Anger Mühlbach Wall Steg'.split())} {n}"
    if k < 0.78:
        return f"{n}{r.choice(('', '', ' bis', ' ter'))}{r.choice((' ', ', '))}{r.choice('rue avenue boulevard impasse chemin place allée quai route'.split())} {r.choice(('', 'de la ', 'du ', 'des ', 'de ', 'de l’'))}{word}"
    return f"{r.choice(('Calle', 'C/', 'Avda.', 'Avenida', 'Plaza', 'Paseo', 'Camino', 'Ronda', 'Travesía'))} {r.choice(('', 'de la ', 'del ', 'de '))}{word}{r.choice((' ', ', '))}{r.choice(('', '', 'n.º ', 'nº '))}{n}"


TOWNS = "Neuhafen|Bad Lindern|Oberwalde|Saint-Oriel|Villaverde|Portcombe|Norwick|Leipzig|Lyon|Sevilla|Boston".split("|")
MAKERS = {"email": email, "phone": phone, "id_number": id_number, "address": address}


def piece(r: random.Random, names: float = 0.45) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence with one item, or one without that looks as if it had one."""
    k = r.random()
    if k < 0.2:
        return _fill(r, r.choice(_NOT).strip()), []
    if k < 0.2 + 0.8 * names:
        frame = r.choice(FRAMES).lstrip()
        before, _, after = frame.partition("{n}")
        x, kind = name(r), "name"
    else:
        kind = r.choice(("email", "phone", "id_number", "address"))
        before, _, after = r.choice(ITEM_FRAMES[kind]).partition("{x}")
        x = MAKERS[kind](r)
        if kind == "address" and r.random() < 0.5:
            after = r.choice((", ", " in ", ", " + _fill(r, "{d}{d}{d}{d}{d} "))) + r.choice(TOWNS) + after
    if r.random() < 0.06:  # in capitals or not
        x = x.upper() if r.random() < 0.5 else x.lower()
    return before + x + after, [(len(before), len(before) + len(x), kind)]


FRAMES = [f for v in NAME_FRAMES.values() for f in v.replace("\n    ", "").split("|")]
