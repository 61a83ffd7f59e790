"""The labelled table of problem 3: lines of letters with marked slots, and what fills the slots.

Written from general knowledge of letters in six languages, not from any corpus: labels are
the usual names of the numbers, carriers are sentences of our own, and names of people,
firms and towns are drawn syllable by syllable, so that only context and shape teach.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "idnum", "address", "name")
LABELS = ["", *KINDS]

# Names of numbers in front of a value, by the slot that they announce.
ID_LABELS = {
    "taxid": "Steuer-ID;Steuer-IdNr.;Steueridentifikationsnummer;Steuerliche Identifikationsnummer;IdNr.;TIN;tax ID;taxpayer number;numéro fiscal;número fiscal;NIF;numero fiscale;fiscaal nummer",
    "rvnr": "Rentenversicherungsnummer;Sozialversicherungsnummer;SV-Nummer;RV-Nummer;Versicherungsnummer;Rentenversicherungs-Nr.",
    "ausweis": "Ausweisnummer;Personalausweisnummer;Personalausweis Nr.;Ausweis-Nr.;Reisepassnummer;Passnummer",
    "iban": "IBAN;IBAN;IBAN-Nr.;Bankverbindung IBAN;Konto IBAN;IBAN code;compte IBAN;cuenta IBAN;conto IBAN;rekening IBAN",
    "nino": "National Insurance number;National Insurance no.;NI number;NINO;NI no.",
    "ssn": "social security number;Social Security no.;SSN",
    "passport": "passport number;passport no.;Passport;travel document no.",
    "secu": "numéro de sécurité sociale;n° de sécurité sociale;Sécurité sociale n°;NIR;n° INSEE",
    "passeport": "numéro de passeport;n° de passeport;passeport n°;Passeport",
    "dni": "DNI;NIF;documento nacional de identidad;D.N.I.;número de DNI",
    "nie": "NIE;N.I.E.;número de extranjero;número de NIE",
    "cf": "codice fiscale;Codice Fiscale;C.F.;cod. fisc.;cod. fiscale",
    "carta": "carta d'identità;carta d'identità n.;documento d'identità n.;C.I. n.",
    "bsn": "burgerservicenummer;Burgerservicenummer;BSN;BSN-nummer;sofinummer",
    "paspoort": "paspoortnummer;Paspoortnummer;paspoort nr.;identiteitskaart nr.",
}
# Sentences around "label value", of all languages: {x} stands for both.
ID_CARRIERS = """
Auf dem Formular steht {x} ganz oben.
Wir führen Sie unter {x} in den Akten.
Bitte geben Sie {x} bei Rückfragen an.
Im Feld darunter fehlt {x} noch.
Gemeldet wurde {x} für das laufende Jahr.
Der Antrag trägt {x} und ein Datum.
Gespeichert ist die {x}. {prose}
Your letter quotes {x} near the top.
We hold {x} under this account.
The form needs {x} before Friday.
They gave {x} on the phone.
On record for the member is {x}. {prose}
Le formulaire cite {x} en haut.
Nous avons noté {x} pour vous.
Indiquez {x} dans toute réponse.
Le courrier mentionne {x} en marge.
El impreso lleva {x} arriba.
Tenemos anotado {x} a su nombre.
Indique {x} en su respuesta.
La carta cita {x} al margen.
Il modulo riporta in alto {x} e la data.
Abbiamo annotato {x} a suo nome.
Indichi {x} nella risposta.
Nella lettera compare {x} a margine.
Op het formulier staat {x} bovenaan.
Wij hebben {x} voor u genoteerd.
Vermeld {x} in uw antwoord.
De brief toont {x} in de kantlijn.
""".strip().split("\n")
NUM_LABELS = (
    "Kundennummer;Kunden-Nr.;Kd.-Nr.;Rechnungsnummer;Rechnung Nr.;Rechnungs-Nr.;Vertragsnummer;Vertrag;Aktenzeichen;Az.;Zählernummer;Zähler;Zählerstand;Bestellnummer;Bestellung;Sendungsnummer;Sendung;Personalnummer;Mitgliedsnummer;Vorgang;Vorgangsnummer;"
    "Artikel;Artikelnummer;Policennummer;Police;Betriebsnummer;Auftragsnummer;Auftrag;Lieferschein;Belegnummer;Referenz;Ticket;"
    "Customer number;Customer no.;Account number;Invoice number;Invoice;Invoice no.;Contract number;Policy number;Policy;File reference;File no.;Meter number;Meter;Meter reading;Order number;Order;Tracking number;Parcel;Staff number;Member number;Item;Request id;Incident;Reference;Ref.;Case;"
    "Numéro client;N° client;Numéro facture;Facture;Facture n°;Numéro contrat;Contrat n°;Référence dossier;Dossier;Numéro compteur;Compteur;Relevé compteur;Numéro commande;Commande;Colis;Matricule;Numéro adhérent;Article;"
    "Número de cliente;Número cliente;Factura;Número factura;Número contrato;Contrato;Expediente;Número contador;Contador;Lectura contador;Número pedido;Pedido;Paquete;Número empleado;Número socio;Artículo;"
    "Numero cliente;Codice cliente;Fattura;Numero fattura;Numero contratto;Contratto;Numero pratica;Pratica;Numero contatore;Contatore;Lettura contatore;Numero ordine;Ordine;Pacco;Matricola;Numero socio;Articolo;"
    "Klantnummer;Factuur;Factuurnummer;Contractnummer;Contract;Dossiernummer;Dossier;Meternummer;Meter;Meterstand;Bestelling;Ordernummer;Pakket;Personeelsnummer;Lidnummer;Artikelnummer"
).split(";")
NUM_KEYS = "kundennummer;rechnungsnummer;vertragsnummer;aktenzeichen;zaehlernummer;mitgliedsnummer;betriebsnummer;bestellnummer;policennummer;personalnummer;customer_no;invoice_no;contract_no;member_no;referenz;reference;ref;numero_client;numero_cliente;klantnummer".split(";")
ID_KEYS = {
    "taxid": "steuer_id;steuernummer;tax_id", "rvnr": "versicherungsnummer;rentenversicherungsnummer;sv_nummer", "ausweis": "ausweisnummer;personalausweis;passnummer", "iban": "iban;konto;bank",
    "nino": "versicherungsnummer;national_insurance", "ssn": "versicherungsnummer;ssn", "passport": "ausweisnummer;passport", "secu": "versicherungsnummer;nir", "passeport": "ausweisnummer;passeport",
    "dni": "ausweisnummer;dni", "nie": "ausweisnummer;nie", "cf": "steuer_id;codice_fiscale", "carta": "ausweisnummer", "bsn": "steuer_id;bsn", "paspoort": "ausweisnummer;paspoort",
}
OTHER_KEYS = "sonstiges;other;kontakt;misc;notiz".split(";")

# Carriers of the other kinds, by language. {t} is a form of address.
CARRIERS = {
    "de": """
Schreiben Sie bitte direkt an {email} oder rufen Sie an.
Die Rechnung kommt künftig per Mail an {email} ins Haus.
Ihre Antwort erreicht uns über {email} am schnellsten.
Fragen gern an {email}.
E-Mail: {email}
E-Mail: {email}. {prose}
Mail an {email}
Tagsüber sind wir telefonisch unter {phone} erreichbar.
Wir bitten um Rückruf, gern über {phone}.
Sie erreichen das Büro unter {phone} bis 16 Uhr.
Bitte um Anruf: {phone}.
Wählen Sie {phone} und fragen Sie nach dem Termin.
Rückruf erbeten unter {phone}.
Rückruf erbeten: {phone}
Bitte Rückruf, {phone}.
Gern auch telefonisch, {phone}.
Wir sind erreichbar unter {phone}
Unsere neue Nummer lautet {phone}.
Tel.: {phone}
Tel. {phone}
Tel. {phone}. {prose}
Telefon {phone}
Telefax: {phone}
Fax {phone}. {prose}
Mobil: {phone}
Handy {phone}
Rückruf unter {phone}
Die neue Wohnung liegt in der {address}.
Er zieht im Mai in die {address}.
Besuchen Sie uns: {address}.
Gemeldet ist die Familie in {address}
Das Paket ging nach {address}.
Wir sind umgezogen, nach {address}.
Bitte zustellen: {address}
Ihre Anschrift lautet jetzt {address}.
Die neue Anschrift: {address}.
Post bitte an: {address}
Seit April lautet die Adresse {address}.
Das Grundstück liegt hier: {address}. {prose}
Anschrift: {address}
Adresse: {address}
Wohnhaft: {address}
Am Montag sprach {name} mit der Hausmeisterei.
Später kam {name} dazu und half.
Gestern schrieb {name} erneut.
Heute war {name} im Haus.
Inzwischen hat {name} bezahlt.
Geprüft wurde das von {name}, Buchhaltung.
Unterschrieben von {name} in {town}.
Unser Gespräch mit {name} war kurz.
{name} holt den Schlüssel am Freitag ab.
Den Termin hat {name} leider abgesagt.
Gestern haben wir {name} nicht erreicht.
Laut {name} ist die Sache erledigt.
Das Paket nahm {name} im Flur entgegen.
Der Garten gehört {name} seit vielen Jahren.
Der Wagen gehörte früher {name} aus dem Nebenhaus.
Danach meldete sich {name} ein zweites Mal.
Abends rief dann {name} an.
Ein Gespräch mit {name} half weiter.
Zugesagt hat das {name}, Abteilungsleitung.
Unterzeichnet: {name}
Unterschrieben hat {name}, Hausmeister.
gez. {name}
gez. {name}. {prose}
i. A. {name}
Ihre Ansprechpartnerin: {name}
Ansprechpartner: {name}. {prose}
Sachbearbeiter: {name}
Kontakt: {name}
Mit freundlichen Grüßen {name}
Sehr geehrte Frau {surname},
Sehr geehrter Herr {surname},
Die Akte bearbeitet {t} {surname} im zweiten Zimmer.
Fragen beantwortet Ihnen {t} {surname}.
Es schreibt Ihnen {t} {surname}.
Gesprochen hat {t} {surname} mit der Bank.
In dieser Angelegenheit hilft {t} {surname}.
Bei uns kümmert sich {t} {name} darum.
Zuständig bleibt {t} {surname}.
Den Brief verfasste {t} {surname}. {prose}
""",
    "en": """
Write to {email} if anything is missing.
The bill goes to {email} from now on.
Our team reads {email} every day.
A second set was mailed to {email} on Tuesday.
Email: {email}
E-mail {email}
Email: {email}. {prose}
Ring {phone} after lunch.
Daytime calls are best reached by {phone}.
You can reach the office on {phone} until four.
Please call {phone}.
Please call back on {phone}.
The team is best reached on {phone} at noon.
Our new number is {phone}.
The helpline on {phone} stays open.
Phone: {phone}
Tel: {phone}
Telephone {phone}. {prose}
Fax: {phone}
Mobile: {phone}
Call back: {phone}.
Their new flat is at {address}.
She moves into {address} in May.
Visit us at {address}.
Send the keys to {address}.
The parcel went to {address}
Since April the family lives at {address}.
Ship to: {address}
Please deliver: {address}.
Address: {address}
Address: {address}. {prose}
On Monday {name} spoke to the caretaker.
Later {name} came by and helped.
Yesterday {name} wrote again.
Today {name} was in the house.
Meanwhile {name} has paid.
Later that day {name} phoned.
Then {name} wrote again.
Checked by {name}, accounts.
Our conversation with {name} was short.
{name} will fetch the key on Friday.
Afterwards {name} called a second time.
We could not reach {name} yesterday.
According to {name} the matter is closed.
The car belongs to {name} next door.
The garden belonged to {name} for years.
A chat with {name} helped a lot.
That was promised by {name}, head of unit.
Signed {name}
Signed, {name}
Signed: {name}. {prose}
Regards, {name}
Your contact: {name}
Contact: {name}
Contact: {name}. {prose}
Dear Mr {surname},
Dear Mrs {surname},
Your case is with {t} {surname} on floor two.
Questions are answered by {t} {surname}.
You are written to by {t} {surname}.
The bank spoke to {t} {surname} today.
The letter was drafted by {t} {name}.
In charge stays {t} {surname}. {prose}
""",
    "fr": """
Écrivez à {email} en cas de doute.
La facture part désormais vers {email} chaque mois.
Notre équipe lit {email} tous les jours.
Un double fut envoyé à {email} mardi.
Courriel : {email}
E-mail : {email}. {prose}
Mél. {email}
Appelez le {phone} après midi.
Merci de nous rappeler, de préférence au {phone}.
Le bureau se joint au {phone} jusqu'à seize heures.
Notre nouveau numéro est le {phone}.
Le standard répond au {phone} à midi.
Prière d'appeler au {phone}.
Tél. : {phone}
Tél. {phone}
Tél. {phone}. {prose}
Fax : {phone}
Portable : {phone}
Leur nouveau logement se trouve {address}.
Elle emménage au {address} en mai.
Venez nous voir : {address}.
Le colis est parti au {address}
Depuis avril la famille habite {address}.
Notre adresse est {address}. {prose}
Envoyer à : {address}
Adresse : {address}
Lundi {name} a parlé au gardien.
Plus tard {name} est venu aider.
Hier {name} a écrit.
Entre-temps {name} a payé.
Vérifié par {name}, comptabilité.
Notre entretien avec {name} fut court.
{name} prendra la clé vendredi.
Ensuite {name} a téléphoné une seconde fois.
Hier, {name} n'était pas joignable.
Selon {name} l'affaire est close.
La voiture appartient à {name} d'à côté.
Le jardin était à {name} depuis longtemps.
Une discussion avec {name} a aidé.
Signature : {name}
Signé {name}
Signé : {name}. {prose}
Votre contact : {name}
Contact : {name}. {prose}
Interlocutrice : {name}
Madame {surname},
Monsieur {surname},
Votre affaire est chez {t} {surname} au deuxième.
Les questions vont à {t} {surname}.
Votre demande est suivie par {t} {surname}.
C'est {t} {surname} qui vous écrit.
La banque a parlé à {t} {surname} hier.
La lettre vient de {t} {name}.
Le responsable reste {t} {surname}. {prose}
""",
    "es": """
Escriba a {email} si falta algo.
La factura llega ahora a {email} cada mes.
Nuestro equipo lee {email} a diario.
Otro ejemplar se mandó a {email} el martes.
Correo: {email}
Correo electrónico: {email}. {prose}
E-mail: {email}
Llame al {phone} por la tarde.
La oficina contesta en el {phone} hasta las cuatro.
Nuestro nuevo número es el {phone}.
Se ruega llamar al {phone}.
Tel.: {phone}
Teléfono: {phone}. {prose}
Fax: {phone}
Móvil: {phone}
El piso nuevo está en {address}.
Ella se traslada a {address} en mayo.
Visítenos en {address}.
El paquete salió hacia {address}
Desde abril la familia vive en {address}.
La dirección actual es {address}. {prose}
Enviar a: {address}
Dirección: {address}
El lunes {name} habló con el portero.
Más tarde {name} vino a ayudar.
Hoy {name} ha escrito.
Mientras tanto {name} ha pagado.
Revisado por {name}, contabilidad.
Nuestra charla con {name} fue corta.
{name} recoge la llave el viernes.
Luego {name} telefoneó otra vez.
Ayer no localizamos a {name} en casa.
Según {name} el asunto está cerrado.
El coche pertenece a {name} de al lado.
El jardín era de {name} hace años.
Una charla con {name} ayudó mucho.
Firma: {name}
Firmado por {name}
Fdo.: {name}. {prose}
Su contacto: {name}
Contacto: {name}. {prose}
Estimado Sr. {surname}:
Estimada Sra. {surname}:
Su caso está con {t} {surname} en la segunda planta.
Las preguntas las responde {t} {surname}.
Le escribe {t} {surname}.
El trámite lo sigue {t} {surname} desde hoy.
La carta la redactó {t} {name}.
El responsable sigue siendo {t} {surname}. {prose}
""",
    "it": """
Scriva a {email} se manca qualcosa.
La bolletta arriva ora a {email} ogni mese.
Il nostro gruppo legge {email} ogni giorno.
Un'altra copia fu mandata a {email} martedì.
Posta: {email}
E-mail: {email}. {prose}
Mail {email}
Chiami il {phone} nel pomeriggio.
In ufficio rispondono al {phone} fino alle quattro.
Il servizio risponde al {phone} a mezzogiorno.
Il nostro nuovo numero è {phone}.
Si prega di chiamare il {phone}.
Tel. {phone}
Tel.: {phone}. {prose}
Telefono: {phone}
Fax: {phone}
Cell. {phone}
La nuova casa si trova in {address}.
Lei si trasferisce in {address} a maggio.
Venga a trovarci in {address}.
Il pacco è partito per {address}
Da aprile la famiglia abita in {address}.
L'indirizzo attuale è {address}. {prose}
Spedire a: {address}
Indirizzo: {address}
Lunedì {name} ha parlato col portiere.
Più tardi {name} è venuto ad aiutare.
Oggi {name} ha scritto.
Intanto {name} ha pagato.
Controllato da {name}, contabilità.
Il nostro colloquio con {name} fu breve.
{name} ritira la chiave venerdì.
Poi {name} ha telefonato un'altra volta.
Ieri non abbiamo trovato {name} in casa.
Secondo {name} la faccenda è chiusa.
L'auto appartiene a {name} della porta accanto.
Il giardino era di {name} da anni.
Una chiacchierata con {name} è servita.
Firma: {name}
Firmato {name}
Firmato: {name}. {prose}
Il suo contatto: {name}
Referente: {name}. {prose}
Egregio signor {surname},
Gentile signora {surname},
Il suo caso è presso {t} {surname} al secondo piano.
Alle domande risponde {t} {surname}.
Le scrive {t} {surname}.
La richiesta è in mano a {t} {surname} da oggi.
La lettera è stata scritta da {t} {name}.
Responsabile resta {t} {surname}. {prose}
""",
    "nl": """
Schrijf naar {email} als er iets mist.
De nota komt voortaan op {email} binnen.
Ons team leest {email} elke dag.
Nog een exemplaar ging dinsdag naar {email} toe.
E-mail: {email}
E-mail: {email}. {prose}
Mail {email}
Bel {phone} na de lunch.
Het kantoor neemt op via {phone} tot vier uur.
Ons nieuwe nummer is {phone}.
Gelieve te bellen naar {phone}.
De balie is bereikbaar op {phone} na tien uur.
Graag terugbellen op {phone}.
Tel.: {phone}
Tel. {phone}. {prose}
Telefoon {phone}
Fax: {phone}
Mobiel: {phone}
De nieuwe woning ligt aan de {address}.
Zij verhuist in mei naar {address}.
Bezoek ons op {address}.
Het pakje ging naar {address}
Sinds april woont het gezin op {address}.
Het huidige adres is {address}. {prose}
Sturen naar: {address}
Adres: {address}
Maandag sprak {name} met de conciërge.
Later kwam {name} helpen.
Vandaag schreef {name} opnieuw.
Intussen heeft {name} betaald.
Nagekeken door {name}, boekhouding.
Ons gesprek met {name} was kort.
{name} haalt vrijdag de sleutel op.
Daarna heeft {name} nogmaals getelefoneerd.
Gisteren konden we {name} niet bereiken.
Volgens {name} is de zaak gesloten.
De auto hoort bij {name} van hiernaast.
De tuin was van {name} sinds jaren.
Een praatje met {name} hielp veel.
Handtekening: {name}
Getekend {name}
Ondertekend: {name}. {prose}
Uw contact: {name}
Contactpersoon: {name}. {prose}
Geachte heer {surname},
Geachte mevrouw {surname},
Uw zaak ligt nu bij {t} {surname} op de tweede etage.
Vragen beantwoordt {t} {surname}.
U krijgt bericht van {t} {surname}.
De aanvraag ligt sinds vandaag bij {t} {surname}.
De brief komt van {t} {name}.
Verantwoordelijk blijft {t} {surname}. {prose}
""",
}
ADDRESS_FORMS = {
    "de": "Herr;Frau;Herr Dr.;Frau Dr.;Frau Prof.;Herr Prof. Dr.;Dr.;Herrn", "en": "Mr;Mrs;Ms;Miss;Dr;Prof.;Mr.;Mrs.;Dr.;Sir", "fr": "M.;Mme;Mlle;Me;Dr;Monsieur;Madame;Pr",
    "es": "el Sr.;la Sra.;D.;D.ª;don;doña;el Dr.;la Dra.", "it": "il sig.;la sig.ra;il dott.;la dott.ssa;l'avv.;il signor;la signora;l'ing.", "nl": "de heer;mevrouw;mevr.;dhr.;dr.;meneer;prof.;mr.",
}

# No items in these: sentences, lines of forms, headings, links, numbers of other kinds.
PLAIN = {
    "de": """
Die Heizung im {small}. Stock wurde am {date} gereinigt und läuft wieder.
Der {firm} Verein lädt zur Versammlung nach {town} ein.
Für {amount} Euro liefert {firm} neue Fenster, sagt {org}.
Unsere Filiale in {town} schließt im März {year} für {small} Tage.
Anbei der Beleg {ref}, den {firm} Energie erst nach der Mahnung schickte.
Wir erhöhen den Abschlag ab Januar {year} auf {amount} Euro.
Wie {org} mitteilt, endet der Tarif {firm} Plus zum {date}.
Das Finanzamt {town} bittet um Geduld, weil Unterlagen aus {town} fehlen.
Am {date} kam der Brief aus {town} an.
Am {date} zahlte {firm} die Rate.
Gültig ab dem {date}, also später.
Gegen Ende {month} meldete sich {firm} wieder.
Bis Mitte {month} zahlt {org} die Rate, ab Anfang {month} wieder {firm}.
Anfang {month} prüfte {org} den Zähler.
Der Keller bleibt wegen Arbeiten bis {small} Uhr gesperrt.
Die Hausverwaltung bestätigt den Eingang der Kündigung.
Laut Krankenkasse {firm} zahlt die Praxis {firm} den Zuschlag nicht.
Eine Kopie des Vertrages liegt im Ordner {town}.
Zwischen {town} und {town} fährt sonntags kein Bus.
Die Firma {firm} nahm den Auftrag der Bank {firm} an, obwohl {org} abriet.
Der Steuerberater prüft den Bescheid über {amount} Euro, danach folgt die Werkstatt.
Der Schaden am Dach kostete im Oktober {amount} Euro mehr als {firm} dachte.
Das Lager von {firm} steht an der Grenze zu {town}.
Seit der Umstellung auf {firm} stimmt der Verbrauch von Zimmer {small} nicht.
""",
    "en": """
The heating on floor {small} was cleaned on {date} and runs again.
The {firm} Club invites members to {town} in spring.
For {amount} pounds {firm} supplies new windows, says {org}.
Our branch in {town} closes in March {year} for {small} days.
Enclosed is receipt {ref}, which {firm} Energy sent after a reminder.
The instalment rises to {amount} pounds from January {year}.
As {org} reports, the {firm} Plus tariff ends on {date}.
The tax office in {town} asks for patience, papers from {town} are missing.
The cellar stays shut until {small} because of building work.
On {date} the letter from {town} came.
On {date}, {firm} paid the rate.
Valid with effect from {date}.
By mid {month} {org} had paid, from late {month} {firm} did.
After long talks, {org} paid the rate to {firm}.
The landlord confirms that the notice has arrived.
{firm} Bank and {firm} Insurance share a desk in {town}.
A copy of the contract is kept in folder {town}.
No bus runs between {town} and {town} on Sundays.
After a request by {firm}, {org} repaired the roof for {amount} pounds.
The garage wrote {ref} on the estimate although {firm} disagreed.
Since the change to {firm} the usage of room {small} looks wrong.
""",
    "fr": """
Le chauffage du {small}e étage fut nettoyé le {date} et marche.
Le club {firm} invite ses membres à {town} au printemps.
Pour {amount} euros, {firm} livre des fenêtres, dit {org}.
Notre agence de {town} ferme en mars {year} pendant {small} jours.
Ci-joint le reçu {ref}, que {firm} Énergie envoya après relance.
La mensualité passe à {amount} euros dès janvier {year}.
Comme l'annonce {org}, le tarif {firm} Plus finit le {date}.
Le fisc de {town} demande patience, des pièces de {town} manquent.
La cave reste fermée à cause des travaux.
Le {date} arriva la lettre de {town}.
Le {date}, {firm} a payé.
Valable avec effet au {date}.
Vers la fin {month}, {org} avait payé.
Après la visite, {org} a réglé {firm}, {org} aussi.
Le bailleur confirme avoir reçu le préavis.
La banque {firm} et {firm} Assurances partagent un guichet à {town}.
Une copie du contrat reste au dossier {town}.
Aucun bus entre {town} et {town} le dimanche.
Le cabinet {firm} a noté {ref} sur le devis malgré {firm}.
Après l'accord de {firm}, {org} a réparé le toit.
""",
    "es": """
La calefacción del piso {small} se limpió el {date} y funciona.
El club {firm} invita a sus socios a {town} en primavera.
Por {amount} euros {firm} entrega ventanas, dice {org}.
Nuestra sucursal de {town} cierra en marzo {year} por {small} días.
Adjunto el recibo {ref}, que {firm} Energía mandó tras avisar.
La cuota sube a {amount} euros desde enero {year}.
Como informa {org}, la tarifa {firm} Plus acaba el {date}.
Hacienda de {town} pide paciencia, faltan papeles de {town}.
El sótano sigue cerrado por obras.
El {date} llegó la carta de {town}.
El {date}, {firm} pagó.
Válido con efecto del {date}.
A fines de {month}, {org} había pagado.
Tras la visita, {org} pagó a {firm}, {org} también.
El casero confirma que llegó el aviso.
El banco {firm} y {firm} Seguros comparten mesa en {town}.
Una copia del contrato queda en la carpeta {town}.
No hay autobús entre {town} y {town} los domingos.
La clínica {firm} anotó {ref} en el presupuesto pese a {firm}.
Con permiso de {firm}, {org} reparó el tejado.
""",
    "it": """
Il riscaldamento del piano {small} fu pulito il {date} e funziona.
Il club {firm} invita i soci a {town} in primavera.
Per {amount} euro {firm} consegna finestre, dice {org}.
La nostra filiale di {town} chiude a marzo {year} per {small} giorni.
In allegato la ricevuta {ref}, che {firm} Energia mandò dopo il sollecito.
La rata sale a {amount} euro da gennaio {year}.
Come informa {org}, la tariffa {firm} Plus finisce il {date}.
Il fisco di {town} chiede pazienza, mancano carte di {town}.
La cantina resta chiusa per lavori.
Il {date} arrivò la lettera da {town}.
Il {date}, {firm} Energia pagò.
Valido con effetto dal {date}.
Verso fine {month}, {org} aveva pagato.
Dopo la visita, {org} ha saldato {firm}, {org} pure.
Per il cambio a {firm}, {org} ha chiuso.
Il padrone di casa conferma la disdetta.
La banca {firm} e {firm} Assicurazioni hanno uno sportello a {town}.
Una copia del contratto resta nella cartella {town}.
Nessun autobus fra {town} e {town} la domenica.
Lo studio {firm} annotò {ref} sul preventivo malgrado {firm}.
Col permesso di {firm}, {org} riparò il tetto.
""",
    "nl": """
De verwarming op etage {small} werd op {date} gereinigd en werkt.
De club {firm} nodigt leden uit naar {town} in de lente.
Voor {amount} euro levert {firm} ramen, zegt {org}.
Ons filiaal in {town} sluit in maart {year} voor {small} dagen.
Bijgaand het bonnetje {ref}, dat {firm} Energie na een aanmaning stuurde.
De termijn stijgt naar {amount} euro vanaf januari {year}.
Zoals {org} meldt, stopt tarief {firm} Plus op {date}.
De fiscus in {town} vraagt geduld, papieren uit {town} ontbreken.
De kelder blijft dicht wegens werk.
Op {date} kwam de brief uit {town}.
Op {date} betaalde {firm}.
Geldig met ingang van {date}.
Eind {month} had {org} betaald.
Na het bezoek betaalde {org} aan {firm}, {org} ook.
De huisbaas bevestigt de opzegging.
Bank {firm} en {firm} Verzekeringen delen een balie in {town}.
Een kopie van het contract zit in map {town}.
Er rijdt geen bus tussen {town} en {town} op zondag.
Praktijk {firm} schreef {ref} op de offerte ondanks {firm}.
Met toestemming van {firm} herstelde {org} het dak.
""",
}
# Nouns that a proper name of a thing, firm or place may follow, and lines with them.
NOUNS = {
    "de": "Amt;Tarif;Vertrag;Police;Konto;Ordner;Bank;Praxis;Verein;Firma;Filiale;Gemeinde;Stadt;Ort;Haus;Schule;Klinik;Kanzlei;Agentur;Kasse;Stelle;Abteilung;Portal;Produkt;Modell;Paket;Marke;Gerät;Anlage;Projekt;Kurs;Hotel;Markt;Werk;Bezirk;Kreis;Büro;Mappe;Heft;Gruppe;Stiftung;Hausgemeinschaft;Siedlung;Apotheke;Bahnhof;Rathaus;Region",
    "en": "tariff;contract;policy;folder;bank;clinic;club;branch;town;school;agency;portal;model;product;brand;plan;office;village;district;hotel;shop;account;surgery;household;project",
    "fr": "tarif;contrat;police;dossier;banque;cabinet;club;agence;ville;école;portail;modèle;produit;mairie;commune;foyer;offre;hôtel;projet;compte",
    "es": "tarifa;contrato;póliza;carpeta;banco;clínica;club;sucursal;ciudad;escuela;portal;modelo;producto;oficina;casa;oferta;hotel;proyecto;cuenta",
    "it": "tariffa;contratto;polizza;cartella;banca;studio;club;filiale;città;scuola;portale;modello;prodotto;comune;casa;offerta;albergo;progetto;conto",
    "nl": "tarief;contract;polis;map;bank;praktijk;club;filiaal;stad;school;portaal;model;product;gemeente;huis;aanbod;hotel;project;rekening",
}
NOUN_LINES = {
    "de": "Dazu kam {noun} {firm}, wie zu lesen war.;Neu ist {noun} {firm}, bald auch {noun} {town}.;Offen blieb {noun} {town}, meint {firm}, trotz allem.;Mit {firm}, dann mit {town} und zuletzt mit {firm} wurde verhandelt.;Wer nach {town}, {town} oder {town} fährt, zahlt mehr.;Es ging um {noun} {firm} und {noun} {town} zugleich.;Soweit {town} betroffen war, half {firm}, später als gedacht.;Gekündigt wurde {noun} {firm}, obwohl {firm} zögerte.;Wir nahmen {noun} {firm}, soweit {town} mitging.;Bei {noun} {town}. Danach kam nichts.;Nach dem Wechsel zu {firm}, {firm} Energie und {firm} Bank blieb alles gleich.;Anfang {month}, Mitte {month} und Ende {month} schrieb {firm} Versicherung.",
    "en": "Next came {noun} {firm}, as one could read.;Also new is the {firm} {noun}, soon the {town} {noun}.;Talks went on with {firm}, then with {town} and last with {firm}.;Whoever goes to {town}, {town} or {town} pays more.;It was about the {noun} in {town}, later about {firm}, despite all.;Since the change to {firm}, {firm} Energy and {firm} Insurance write less.;In early {month}, {firm} Bank wrote; by late {month}, {firm} Insurance did.;After a visit, {firm} Energy left the {noun} {town}.",
    "fr": "S'ajoute {noun} {firm}, comme on a pu lire.;Nouveau aussi, {noun} {firm}, bientôt {noun} {town}.;On traita avec {firm}, puis avec {town} et enfin avec {firm}.;Qui va à {town}, {town} ou {town} paie plus.;Il s'agissait du {noun} de {town}, puis de {firm}, malgré tout.;Depuis le passage chez {firm}, {firm} Énergie et {firm} Assurances écrivent moins.;Début {month}, {firm} Assurances écrivit ; fin {month}, la banque {firm} aussi.",
    "es": "Se añade {noun} {firm}, como se pudo leer.;Nuevo también {noun} {firm}, pronto {noun} {town}.;Se trató con {firm}, luego con {town} y al fin con {firm}.;Quien va a {town}, {town} o {town} paga más.;Era por {noun} de {town}, luego por {firm}, pese a todo.;Desde el paso a {firm}, {firm} Energía y {firm} Seguros escriben menos.;A inicios de {month}, {firm} Seguros escribió; a fines de {month}, el banco {firm} también.",
    "it": "Si aggiunge {noun} {firm}, come si è letto.;Nuovo anche {noun} {firm}, presto {noun} {town}.;Si trattò con {firm}, poi con {town} e infine con {firm}.;Chi va a {town}, {town} o {town} paga di più.;Era per {noun} di {town}, poi per {firm}, malgrado tutto.;Dal cambio a {firm}, {firm} Energia e {firm} Assicurazioni scrivono meno.;A inizio {month}, {firm} Assicurazioni scrisse; a fine {month}, la banca {firm} pure.;Dopo la visita, {firm} Energia lasciò {noun} {town}.",
    "nl": "Daarbij kwam {noun} {firm}, zoals te lezen was.;Ook nieuw is {noun} {firm}, straks {noun} {town}.;Er werd overlegd met {firm}, dan met {town} en ten slotte met {firm}.;Wie naar {town}, {town} of {town} gaat, betaalt meer.;Het ging om {noun} in {town}, later om {firm}, ondanks alles.;Sinds de wissel naar {firm}, {firm} Energie en {firm} Verzekeringen schrijven ze minder.;Begin {month}, half {month} en eind {month} schreef {firm} Verzekeringen.",
}
LINES = """
# {title}
# {title} {town}
## {title} {town}
## {title}
**{title}**
- {date}
- {date} {prose}
{date}
_Source: {file}_
_Source: {file}_ {prose}
- [{file}](../{word}/{year}/{file})
- [{word}_{small}.md](../{word}/{word}_{small}.md)
type: {word}
title: {title}: [{ref}
path: /{word}/{file}
{prose} ({small}:{small} / {year})
{prose} {prose}
{firm} {firm_kind}
{org}
{org}: {title} {ref}
{amount} Euro
{amount} EUR {firm}
Uhrzeit {small}:{small}, Raum {small}
Error {small}: request {num} failed.
{prose} {num_label} {num}. {prose}
{num_label} {num} / {num_label} {num}
{num_label}: {num} {prose}
{num_label} {procnum}.
{num_label}: {procnum}
{num_label} {num}.
- {num_label}: {num}
{num_label}: {num}
{num_label} {num}
""".strip().split("\n")

# Fixed values for the slots: common given names, titles of papers, kinds of firms, months.
GIVEN = "Anna Peter Thomas Sabine Klaus Monika Jürgen Petra Emily Oliver Harriet George Alice Henry Camille Julien Élodie Antoine Hélène Carmen Pablo Lucía Javier Inés Giulia Marco Francesca Paolo Elena Daan Sanne Pieter Femke Joost".split()
TITLES = "Rechnung;Vertrag;Bescheid;Mahnung;Angebot;Protokoll;Jahresbericht;Bestätigung;Invoice;Contract;Reminder;Annual Report;Service Note;Bank Letter;Facture;Contrat;Relevé annuel;Avis;Quittance loyer;Factura;Contrato;Aviso anual;Recibo luz;Fattura;Contratto;Avviso annuale;Ricevuta affitto;Factuur;Contract huur;Jaarbericht;Aanmaning;Polis".split(";")
FIRM_KINDS = "Bank Versicherung Versicherungen Energie Insurance Energy Assurances Énergie Seguros Energía Assicurazioni Energia Verzekeringen Plus Direkt Holding Clinic Praxis Service Club".split()
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember January February March May June July October December janvier février mars avril juin juillet août septembre enero marzo abril mayo junio julio agosto gennaio febbraio aprile maggio giugno luglio ottobre januari maart mei juli augustus oktober".split()
WORDS = "bank haus strom police akte brief folder note dossier carta posta map lijst vertrag rechnung bill".split()


class Filler:
    """Fills the slots of the table, from a fixed seed."""

    def __init__(self, given: list[str], seed: int = 5):
        self.r = random.Random(seed)
        self.given = sorted({*given, *GIVEN})

    def digits(self, pattern: str) -> str:
        """9: a digit, A: a capital letter; anything else stays."""
        return "".join(self.r.choice("0123456789") if c == "9" else self.r.choice("ABCDEFGHJKLMNPRSTVXYZ") if c == "A" else c for c in pattern)

    def one(self, patterns: str) -> str:
        return self.digits(self.r.choice(patterns.split("|")))

    def word(self, ends: str = "l n r s nd rt lt mp") -> str:
        """A word that no language has: two to four drawn syllables."""
        r = self.r
        heads = "b br d dr f fl g gr h j k kl kr l m n p pl qu r s sch st t th tr v w z".split()
        return "".join(r.choice(heads) + r.choice("aeiou") for _ in range(r.choice((1, 1, 2)))) + r.choice(heads[:-1]) + r.choice("aeiou") + r.choice(["", *ends.split()])

    def surname(self) -> str:
        ends = "l n r s nd lt tti sson mann ski kamp inga berg ez ini ier ius"
        s = self.word(ends).capitalize()
        if self.r.random() < 0.15:
            s += "-" + self.word(ends).capitalize()
        return s.upper() if self.r.random() < 0.12 else s

    def first(self) -> str:
        return self.r.choice(self.given) if self.r.random() < 0.6 else self.word().capitalize()

    def name(self) -> str:
        given, own = self.first(), self.surname()
        return self.r.choice([f"{given} {own}"] * 5 + [f"{given[0]}. {own}"] * 2 + [f"{given} {self.r.choice('ABEGMST')}. {own}"] + [f"{own}, {self.r.choice(self.given)}"])

    def town(self) -> str:
        return self.word("l n r nd heim stadt burg by hoven ville dorf ham ton ona").capitalize() if self.r.random() < 0.95 else f"{self.word().capitalize()} am {self.word().capitalize()}"

    def org(self) -> str:
        x = self.word().capitalize()
        return self.r.choice([f"{x} Bau GmbH", f"{x} GmbH", f"{x} AG", f"{x} & Sohn KG", f"{x} e.V.", f"{x} Builders Ltd", f"{x} Services Inc", f"la maison {x} et fils", f"{x} SARL", f"Établissements {x}", f"Construcciones {x}", f"Talleres {x} S.L.", f"Edilizia {x}", f"Impresa {x} S.r.l.", f"Bouwbedrijf {x}", f"{x} B.V."])

    def email(self) -> str:
        r = self.r
        own, given = self.word(), self.first().lower().replace("é", "e").replace("ü", "u")
        left = r.choice([f"{given}.{own}", f"{own}_{given}", f"{own}{r.randint(1, 99)}", f"{r.choice(['info', 'post', 'kontakt', 'office', 'service'])}-{own}", f"{given}+{r.choice(['post', 'mail', 'news'])}", f"{given[0]}{own}", f"{given[0]}.{own}", own])
        right = r.choice(["", "", "mail.", "post."]) + self.word() + r.choice(["", "", "-haus", "-online"]) + r.choice([".example", ".test", ".invalid", ".de", ".com", ".org", ".fr", ".nl"])
        way = r.random()
        if way < 0.4:
            return f"{left}@{right}"
        if way < 0.5:
            return f"{left}@{right}".upper()
        if way < 0.62:
            return f"{left} @ {right}"
        if way < 0.75:
            return f"{left} (at) {right}"
        if way < 0.88:
            return f"{left}[at]{right.replace('.', '[dot]')}"
        return f"{left} AT {right.replace('.', ' DOT ')}"

    def number(self) -> str:
        """Digits in one run or in groups, as numbers of customers, invoices and the like are written."""
        r = self.r
        sep = r.choice(["", "", "", " ", " ", " ", "-", "/", "."])
        zero = r.random() < 0.15
        if not sep:
            return ("0" if zero else "") + self.digits("9" * r.choice((6, 7, 8, 9, 10, 10, 10, 11, 12, 13, 14, 15)))
        # Blanks stand after a longer group: short ones first are how people write other numbers.
        first = r.choice((4, 4, 5, 6)) if sep == " " else r.choice((3, 3, 4, 5, 6))
        whole = sep.join(self.digits("9" * g) for g in [first, *(r.choice((3, 3, 3, 4, 4, 5)) for _ in range(r.choice((1, 2, 2))))])
        return "0" + whole[1:] if zero else whole

    def phone(self, lang: str) -> str:
        return self.one(
            {
                "de": "0999/99999999|0999 99999 999|(0999) 999 99-999|030/99999999|030 99999 999|(030) 999 99-999|+49 30 99999999|+49 999 9999999|+49 30 99999 99 9|+49 (0)199 99 999 99|0049 30 99999 999|0049 999 9999999|0199 9999999|0199 99 99 999|01999999999|03099999999|(0199) 999 99-99|0199/9999999",
                "en": "09999 999999|020 9999 9999|+44 9999 999 999|+44 20 9999 9999|07999 999999|07999 999 999|(999) 999-9999|+1-999-999-9999|+1 999 999 9999|999.999.9999|999-999-9999|0044 9999 999999|09999999999",
                "fr": "01 99 99 99 99|06 99 99 99 99|0199999999|01.99.99.99.99|06.99.99.99.99|+33 1 99 99 99 99|0033 1 99 99 99 99|+33 199999999|01-99-99-99-99",
                "es": "999 999 999|+34 999 99 99 99|0034-999-999999|999-999-999|999999999|+34 999 999 999|999 99 99 99|699 999 999|600999999",
                "it": "099 99 99 999|+39 099 9999 999|06 99999999|0999999999|099-9999999|099/9999999|0039 099 9999999|+39 0999999999|399 9999999",
                "nl": "020-9999999|(020) 999 9999|+31 20 9999 999|0031 20 9999999|020 9999 999|0209999999|+31 209999999|06-99999999|+31 6 99999999",
            }[lang]
        )

    def address(self, lang: str) -> str:
        r, street, town = self.r, self.word().capitalize(), self.town()
        no, zip_ = str(r.randint(1, 199)), self.digits("99999")
        letter = no + r.choice("abc")
        if lang == "de":
            kind = r.choice(["str.", "str.", "straße", "straße", "weg", "allee", "gasse", "platz", "ring", "ufer"])
            lead = r.choice([f"{street}{kind}"] * 5 + [f"Am {street}", f"An der {street}", f"{street} Straße", f"Im {street}"])
            return f"{lead} {r.choice([no, letter, f'{no}/{r.randint(1, 40)}'])}" + r.choice(["", f", {town}", f", {zip_} {town}", f", D-{zip_} {town}"])
        if lang == "en":
            return r.choice(["", "", "", f"Flat {r.randint(1, 20)}, ", f"Unit {r.randint(1, 20)}, "]) + f"{r.choice([no, letter])} {street} " + r.choice("Close Lane St. St. Road Street Rd. Rd. Avenue Drive Court Way Terrace".split()) + r.choice(["", f", {town}", f", {town} {self.digits('A9 9AA')}", f", {town}, {self.digits('AA9 9AA')}"])
        end = r.choice(["", f", {town}", f", {zip_} {town}", f", {zip_} {town}"])
        if lang == "fr":
            kind = r.choice("rue avenue allée bd boulevard place impasse chemin quai".split())
            return f"{no}{r.choice([',', '', ' bis,', ' ter'])} {kind} {r.choice(['', '', 'de ', 'du '])}{street}" + end
        if lang == "es":
            lead = r.choice(["Calle", "C/", "Avda.", "Avenida", "Plaza", "Paseo", "Camino"])
            return f"{lead} {street}{r.choice(['', ','])} {no}" + r.choice(["", "", f", {r.randint(1, 9)}º {r.choice('ABC')}"]) + end
        if lang == "it":
            lead = r.choice(["Via", "Via", "Piazza", "V.le", "Viale", "Corso", "P.za", "Largo"])
            return f"{lead} {street} {no}{r.choice(['', '', '/A', '/B'])}" + end
        kind = r.choice("laan straat kade weg plein gracht dreef".split())
        return f"{street}{kind} {r.choice([no, no, letter, f'{no}-{r.randint(1, 9)}'])}" + r.choice(["", f", {town}", f", {self.digits('9999 AA')} {town}"])

    def idnum(self, slot: str) -> str:
        if slot == "iban":
            iban = self.one("DE99 9999 9999 9999 9999 99|DE99999999999999999999|DE99 9999 9999 9999 9999 99|DE99999999999999999999|AT99 9999 9999 9999 9999|FR99 9999 9999 9999 9999 9999 999|ES99 9999 9999 9999 9999 9999|ES9999999999999999999999|NL99 AAAA 9999 9999 99|NL99AAAA9999999999|IT99 A999 9999 9999 9999 9999 999|GB99 AAAA 9999 9999 9999 99")
            return iban if self.r.random() < 0.75 else iban.lower()
        return self.one(
            {
                "taxid": "99 999 999 999|99999999999", "rvnr": "99 999999 A 999|99999999A999|99999999 A 999|99-999999-A-999",
                "ausweis": "A9999999999|A99A99A999|L99A99A99|T999999999|A99999999", "nino": "AA 99 99 99 A|AA999999A|AA 999999 A", "ssn": "999-99-9999|999 99 9999", "passport": "A99999999|999999999|AA9999999",
                "secu": "1 99 99 99 999 999 99|2 99 99 99 999 999 99|199999999999999|2 99 99 99 999 999", "passeport": "99AA99999", "dni": "99.999.999-A|99999999A|99999999-A|99.999.999 A",
                "nie": "X-9999999-A|Y9999999A|X9999999A|Z-9999999-A", "cf": "AAAAAA99A99A999A|AAA AAA 99A99 A999A", "carta": "AA99999AA|AA9999999|AA 9999999", "bsn": "9999.99.999|999999999|9999 99 999|999.999.999", "paspoort": "AA9999999|AAA999999|AA999A99A",
            }[slot]
        )

    def fill(self, slot: str, lang: str) -> str:
        r = self.r
        if slot in ID_LABELS:
            return self.idnum(slot)
        made = {
            "email": self.email, "phone": lambda: self.phone(lang), "address": lambda: self.address(lang), "name": self.name, "surname": lambda: r.choice([self.surname()] * 3 + [self.name()]),
            "t": lambda: r.choice(ADDRESS_FORMS[lang].split(";")), "num": self.number, "num_zero": lambda: "0" + self.number()[1:], "procnum": lambda: self.one("030-9999999999|9999999999-99|099-999999-99|99.9999|99,9999|0199/99999999"),
            "num_label": lambda: r.choice(NUM_LABELS), "small": lambda: str(r.randint(1, 99)), "year": lambda: f"20{r.randint(10, 29)}", "amount": lambda: self.one("9.999,99|999,99|9,999.99|99,90|999.99"),
            "ref": lambda: self.one("AA-99999|AA-9999|A999-99|AA9999"), "firm": lambda: self.word("l n r x s nd rt ix ora flow plan tec net tarif strom").capitalize(), "firm_kind": lambda: r.choice(FIRM_KINDS), "town": self.town, "org": self.org, "title": lambda: r.choice(TITLES),
            "month": lambda: r.choice(MONTHS), "noun": lambda: r.choice(NOUNS[lang].split(";")), "word": lambda: r.choice(WORDS), "file": lambda: f"{r.choice(WORDS)}_{r.randint(1, 40)}.{r.choice(['pdf', 'txt', 'md', 'csv'])}", "prose": lambda: self.plain(lang),
            "date": lambda: r.choice([self.digits("2099-09-09"), self.digits("09.09.2099"), self.digits("09/09/2099"), f"{r.randint(1, 28)}. {r.choice(MONTHS)} 20{r.randint(10, 29)}", f"{r.randint(1, 28)} {r.choice(MONTHS)} 20{r.randint(10, 29)}", f"{r.randint(1, 28)} de {r.choice(MONTHS)} de 20{r.randint(10, 29)}"]),
        }
        return made[slot]()

    def plain(self, lang: str) -> str:
        """A sentence without items."""
        return self.filled(self.r.choice(PLAIN_LINES[lang]), lang)[0]

    def filled(self, line: str, lang: str) -> tuple[str, list[tuple[int, int, int]]]:
        """The line, and (start, end, label) of its items."""
        text, marks = "", []
        for i, part in enumerate(re.split(r"\{(\w+)\}", line)):
            value = self.fill(part, lang) if i % 2 else part
            if i % 2 and (kind := kind_of_slot(part)):
                marks.append((len(text), len(text) + len(value), LABELS.index(kind)))
            text += value
        return text, marks


PLAIN_LINES = {lang: lines.strip().split("\n") for lang, lines in PLAIN.items()}


def kind_of_slot(slot: str) -> str:
    return "idnum" if slot in ID_LABELS else "name" if slot == "surname" else slot if slot in KINDS else ""


def lines(filler: Filler, fold: int | None = None, folds: int = 5) -> list[tuple[str, str, int]]:
    """(line with slots, language, times to fill it) of the whole table; with a fold, without every line of that fold, so that it can be held out."""
    r, langs = filler.r, list(CARRIERS)
    out: list[tuple[str, str, int]] = []
    for lang in langs:
        own = CARRIERS[lang].strip().split("\n")
        # phones and addresses have more notations than lines
        out += [(line, lang, 24 if "{phone}" in line or "{address}" in line or "{t}" in line else 10 if "name}" in line else 6) for i, line in enumerate(own) if i % folds != fold]
        out += [(line, lang, 4) for line in PLAIN_LINES[lang]]
        for noun in NOUNS[lang].split(";"):
            out += [(line.replace("{noun}", noun), lang, 1) for line in r.sample([x for x in NOUN_LINES[lang].split(";") if "{noun}" in x], 3 if lang == "de" else 2) for _ in range(2)]
        out += [(line, lang, 8) for line in NOUN_LINES[lang].split(";") if "{noun}" not in line]
        # Items in the midst of any sentence: there their own look has to do.
        for kind, n in (("phone", 80), ("name", 70), ("address", 40), ("email", 15)):
            for _ in range(n):
                words = r.choice(PLAIN_LINES[lang]).split(" ")
                at = r.randint(2, len(words) - 1)
                out.append((" ".join([*words[:at], f"{{{kind}}}", *words[at:]]), lang, 1))
    for slot, labels in ID_LABELS.items():
        for k, label in enumerate(labels.split(";")):
            mark, lang = f"{label}{{sep}}{{{slot}}}", r.choice(langs)
            carriers = [c.replace("{x}", f"{label} {{{slot}}}") for i, c in enumerate(ID_CARRIERS) if i % folds != fold]
            out += r.sample([(mark.replace("{sep}", sep) + end, lang, 1) for sep in (": ", " ", " : ") for end in ("", ".", ". {prose}")], 5)
            out += [(r.choice(carriers), lang, 1) for _ in range(18 if k < 3 else 8)]
        for key in ID_KEYS[slot].split(";"):
            out.append((f"{key}: {{{slot}}}", "de", 4))
        out += [(f"{r.choice(OTHER_KEYS)}: {{{slot}}}", "de", 2), (f"{{{slot}}}", "de", 2), (f"{{{slot}}}. {{prose}}", r.choice(langs), 1), (f"{{prose}} {{{slot}}}. {{prose}}", r.choice(langs), 1)]
    for key in NUM_KEYS:
        out += [(f"{key}: {{num}}", "de", 36), (f"{key}: {{num_zero}}", "de", 8)]
        for value in ("n/a", "unbekannt", "s.o.", "-", "xxx", "none", "siehe oben", "0000000", "000 000 00", "1111111", "123456"):
            out.append((f"{key}: {value}", "de", 1))
        # values that stand under the wrong key
        out += [(f"{key}: {{{slot}}}", r.choice(langs), 1) for slot in (*KINDS[:2], *KINDS[3:], "name", "iban", "iban", "taxid", "rvnr", "ausweis", "cf")]
    for key in (*OTHER_KEYS, "telefon", "phone", "anschrift", "adresse", "name", "email"):
        out += [(f"{key}: {{{slot}}}", lang, 2) for slot in ("phone", "email", "address", "name") for lang in r.sample(langs, 3)]
    for label in NUM_LABELS:
        out += [(form.replace("{num_label}", label, 1), r.choice(langs), 2) for form in ("{num_label} {num}.", "- {num_label}: {num}", "{num_label}: {num}", "{num_label} {num}. {prose}", "{prose} {num_label} {num}.")]
    for line in LINES:
        out += [(line, lang, 5) for lang in langs]
    return out


def texts(given: list[str], seed: int = 5, fold: int | None = None) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The table filled: texts of one line, with the places of their items."""
    filler = Filler(given, seed)
    out = []
    for line, lang, times in lines(filler, fold):
        for _ in range(times):
            before = "{prose} " if line[0].isupper() and ":" not in line and filler.r.random() < 0.25 else ""
            after = " {prose}" if line[-1] == "." and filler.r.random() < 0.25 else ""
            text, marks = filler.filled(before + line + after, lang)
            if filler.r.random() < 0.02 and len(text.upper()) == len(text):
                text = text.upper()
            out.append((text, marks))
    return out


def held_out(given: list[str], seed: int, fold: int, folds: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Filled carriers of one fold only: sentences that texts(fold=fold) has never seen."""
    filler, out = Filler(given, seed), []
    for lang, own in CARRIERS.items():
        for i, line in enumerate(own.strip().split("\n")):
            if i % folds == fold:
                out += [filler.filled(line, lang) for _ in range(3)]
    for slot, labels in ID_LABELS.items():
        for i, c in enumerate(ID_CARRIERS):
            if i % folds == fold:
                out.append(filler.filled(c.replace("{x}", f"{labels.split(';')[i % len(labels.split(';'))]} {{{slot}}}"), "de"))
    return out
