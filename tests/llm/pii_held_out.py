"""Sentences that no detector was trained on: other frames, other values, hard negatives.

Frames and values were written by hand, apart from those of the training sentences; given
names are partly in the lexicon of the tests and partly in none.
"""

LISTED = ["Solen", "Yvela", "Miran", "Kala", "Dorik", "Elsa", "Tovan", "Runa", "Jorik", "Helen", "Nadya", "Fenik"]
UNLISTED = ["Grace", "Tomasz", "Amara", "Björn", "Chloé", "Iñigo"]
SURNAMES = ["Whitlock", "Okafor", "Nakamura", "Lindqvist", "García", "Müller", "Brown", "O’Neill", "Fernandes", "Zhang", "Kowalczyk", "Abernathy", "Duval", "Petrov", "Castellanos", "Hughes"]

FRAMES = {
    "email": [
        "If anything breaks overnight, {} gets the alert.", "The old mailbox {} will be closed in May.", "git config user.mail {}", "Questions? {} knows.", "Kopie ging heute früh an {}.", "Le rapport a été transmis à {} hier soir.", "El aviso llegó a {} esta mañana.",
        "smtp: 550 rejected <{}>", "assignees: [{}]", "she signed up with {} last year", "export ADMIN={}", "- {} (primary)",
    ],
    "phone": [
        "If nobody answers the door, try {} instead.", "Out of hours the duty engineer picks up at {}.", "I left my mobile at home, so use {} until Friday.", "Unter {} ist der Empfang bis 18 Uhr besetzt.", "Le standard répond au {} de 9 h à 17 h.", "Para urgencias marque {} a cualquier hora.",
        "sms sent to {}", "callback={}", "* hotline: {}", "His landline, {}, was disconnected.", "reachable by phone ({}) or letter", "Fax-Nr. {}",
    ],
    "id_number": [
        "The applicant's passport, {}, expires in June.", "Her social security number ({}) was visible in the screenshot.", "Please redact the national identity number {} before sharing.", "Der Personalausweis {} wurde kopiert.", "Son numéro de sécurité sociale, {}, figure au dossier.", "El DNI {} no coincide con el del contrato.",
        "taxpayer number: {}", "tax id {} is on the invoice header", "applicant.ssn = {}", "identity document no. {} issued in 2019", "driver license {} was scanned", "insurance number {} belongs to the claimant",
    ],
    "address": [
        "The keys can be collected from {} until six.", "Since spring the family lives at {} again.", "Return the faulty unit to {} within a week.", "Der Umzug nach {} ist geplant.", "Le colis est parti hier vers {} par erreur.", "La reunión será en {} a las nueve.",
        "ship_to: {}", "billing address = {}", "the clinic ({}) opens at 8", "Her new place is {} by the canal.", "Invoices go to {} from now on.", "Registered office: {}",
    ],
    "person": [
        "My name is {} and I look after the database.", "The bug was first seen by {} in Lisbon.", "Could {} take the late shift on Friday?", "Nachfragen beantwortet {} gern persönlich.", "La décision revient à {} seule.", "El informe lo firmó {} ayer.",
        "reviewers: {}", "created_by = {}", "I spoke with {} about the invoice.", "Dear {}, thank you for waiting.", "the account of {} was locked", "({}, personal communication)",
    ],
}
VALUES = {
    "email": ["grace.hopper@navy.example", "t.kowalski+lists@uni.example.org", "ops-team@hutch.example", "amara at okafor dot example", "j_doe(at)inbox.example", "contact [at] duval [dot] example", "x" * 150 + "@long.example", "m.mueller99@post.example.de"],
    "phone": ["+1 212 555 0188", "(415) 555-0132", "646-555-0170", "+44 20 7946 0958", "07700 900123", "+49 89 6371 2204", "089/6371220", "+33 6 12 34 56 78", "01 42 68 53 00", "+34 612 345 678", "0034 912 345 678", "+1-503-555-0144 ext. 12"],
    "id_number": ["123-45-6789", "078-05-1120", "AB 12 34 56 C", "QQ123456C", "C01234567", "XK4471902", "12345678Z", "X1234567L", "1 85 05 78 006 084 36", "65 929 970 489", "12345678-Z", "B12345678"],
    "address": [
        "14 Tanner’s Hill, Oxford OX2 6JF", "221 Baker Street, London NW1 6XE", "1600 Garfield Avenue, Springfield, IL 62704", "Flat 3, 9 Harbour Road, Whitby YO21 3QJ", "48 Larkspur Lane", "12, rue de la Paix, 75002 Paris", "5 bis, avenue Foch, 69006 Lyon", "Calle de Alcalá 45, 28014 Madrid",
        "Hauptstraße 5, 10115 Berlin", "Lindenallee 17b, 50667 Köln", "Goethestr. 3, 60313 Frankfurt", "750 Mission Boulevard, Suite 210, Austin, TX 78701",
    ],
}
VALUES["person"] = [
    *[f"{g} {s}" for g, s in zip(LISTED, SURNAMES[:12], strict=True)], *[f"{g} {s}" for g, s in zip(UNLISTED, SURNAMES[10:], strict=True)], "Whitlock, Helen", "Petrov, Miran", "R. Nakamura", "Elsa M. Castellanos", "Runa van Dijk", "Okafor, J.",
]

HARD_NEGATIVES = [
    "Order 4471-2290-18 left the warehouse at 10:42:07.", "Parcel 123-456-7890 was scanned twice.", "Build 20240117.3 replaced build 20240116.9.", "The checksum 00fa13cc9b77 did not match.", "RFC 2119 and ISO 8601-1 apply.", "Invoice 90218475 covers rows 100200 to 100260.", "Latency fell from 1200 345 to 900 ms.",
    "Rechnung Nr. 4471902 liegt bei.", "Commande 882-19-4410 expédiée.", "El pedido 12345678 sigue abierto.", "Listening on 192.168.10.24:8080 since 2024-03-01 10:15:00.", "Use model X12345678 or later.", "Ports 49152-65535 are dynamic.", "Epoch 1700000000 is in November.", "trace_id=4bf92f3577b34da6a3ce929d0e0e4736",
    "Open Source Initiative and Apache Software Foundation approve it.", "See Getting Started and the Quick Reference.", "New York and Los Angeles were offline.", "Visual Studio Code needs a restart.", "The Elsa Gateway accepts both.", "Runa 4.1 drops support for Python 3.8.", "Upgrade Kala Cloud before Monday Morning.", "Die Neue Version steht im Netz.",
    "La Guía Rápida está en la Página Principal.", "Helen arrived late.", "We asked Miran twice.", "Release Candidate Two is out.", "Null Pointer Exception in Worker Thread.", "Please read the Terms of Service.", "npm install @angular/core@17.0.1", "pip install solen-tools==1.2.3", "git clone git@forge.example:miran/tools.git", "follow @runa_dev on the forum",
    "meet at noon dot dot dot", "the value at index.html is stale", "Main Street was the code name.", "Chapter 12, Section 4, Table 9", "12 Monkeys and 7 Dwarfs", "Version 5 Alpha, 10115 downloads", "It costs 1,200 or 1 350 in total.", "North Sea Protocol", "Red Hat Enterprise Linux 9", "Content-Length: 123456789", "Summer Time ends on 27 October.",
]

#: A second set, of frames and values that no part of the training was tuned to (only its threshold was).
FRAMES_B = {
    "email": ["The bounce message named {}.", "Anmeldungen nimmt {} entgegen.", "invite {} to the channel", "key owner <{}>", "Une copie est partie vers {}.", "se envió a {} el lunes"],
    "phone": ["Her extension changed, the new line is {}.", "wer Fragen hat, wählt {}", "telephone={}", "Appel manqué du {}", "llamadas al {} sin respuesta", "(mobile {})"],
    "id_number": ["the visa desk wrote down passport {} by hand", "SSN: {}", "identity card {} was lost", "la carte d’identité {} a été volée", "número de identidad {} verificado", "Steuernummer {} fehlt auf dem Beleg"],
    "address": ["The courier rang at {} but nobody was in.", "Unsere Werkstatt: {}", "le siège se trouve {}", "el taller está en {}", "venue = {}", "They rent a flat at {}."],
    "person": ["{} chaired the meeting on Monday.", "Sprecherin der Gruppe ist {}.", "signataire : {}", "La autora es {}.", "patch by {}", "ask {} before merging"],
}
VALUES_B = {
    "email": ["li.wei@campus.example", "press@ministry.example.gov", "s.brandt [at] werk [dot] example", "o_nuñez_22@correo.example.es".replace("ñ", "n"), "dev+bot@code.example.io"],
    "phone": ["+1-720-555-0151", "(312) 555-0199", "+44 161 496 0018", "+49 711 2284556", "+33 4 91 22 33 44", "+34 699 112 233"],
    "id_number": ["219-09-9999", "PB 65 43 21 A", "K98765432", "87654321X", "Z7654321B", "2 91 11 13 055 123 44"],
    "address": ["7 Orchard Close, Bristol BS6 5QA", "2250 Pinecrest Drive, Boulder, CO 80301", "33, rue Saint-Honoré, 75001 Paris", "Calle Mayor 12, 28013 Madrid", "Bergstraße 9a, 69120 Heidelberg", "61 Victoria Terrace"],
    "person": ["Elsa Marchetti", "Fenik Osei", "Nadya Rosenthal", "Priya Raman", "Mateus Carvalho", "K. Lundgren", "Haddad, Kala", "Runa J. Bellweather"],
}


def cases_b() -> list[tuple[str, list[tuple[str, str]]]]:
    """(text, [(type, value)]) of the second set: every value in three of its frames."""
    return [
        (FRAMES_B[kind][(i + 2 * k) % 6].replace("{}", value), [(kind, value)]) for kind, values in VALUES_B.items() for i, value in enumerate(values) for k in range(3)
    ]


def cases() -> list[tuple[str, list[tuple[str, str]]]]:
    """(text, [(type, value)]): every value in four frames of its type, and the negatives."""
    out = [(t, []) for t in HARD_NEGATIVES]
    for kind, values in VALUES.items():
        for i, value in enumerate(values):
            for k in range(4):
                frame = FRAMES[kind][(i * 5 + k * 3) % len(FRAMES[kind])]
                out.append((frame.replace("{}", value), [(kind, value)]))
    return out
