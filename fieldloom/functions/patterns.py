"""Field patterns and segment rules, kept as data. Plain ASCII classes, equal in Java's and other engines' regular expressions."""

from __future__ import annotations

# What each field looks like, and which segments a rule is after.
FIELDS = {
    "email": "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.]*[A-Za-z0-9]",
    "phone": "[+][0-9]{1,3} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}",
    "ip": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}",
    "card": "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}",
    "token": "[0-9a-f]{40}",
}
RULES = {"r_with": "with", "r_avec": "avec", "r_shall": "shall", "r_at": "@"}
#: What a request for proposals is read for: obligations, dates, amounts, submission and evaluation.
PROCUREMENT = {
    "obligation": "(^|[^A-Za-z])([Ss]hall|[Mm]ust|[Ii]s required to)([^A-Za-z]|$)",
    "deadline": "(^|[^A-Za-z])([Dd]eadline|[Dd]ue (date|by|on)|[Nn]o later than|[Cc]losing date)([^A-Za-z]|$)",
    "date": "(^|[^0-9])[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])([^0-9]|$)",
    "amount": "([$]|USD |EUR |GBP )[0-9]{1,3}(,?[0-9]{3})*([.][0-9]{2})?([^0-9]|$)",
    "submission": "(^|[^A-Za-z])([Ss]ubmit|[Ss]ubmission|[Ss]ealed bids?)([^A-Za-z]|$)",
    "evaluation": "([Ee]valuation criteria|[Aa]ward criteria|[Ss]cored? (on|by)|[Ww]eight(ing|ed))",
}
PARTS = {"title": "<title>([^<]*)</title>", "link": '<a href="([^"]*)"', "paragraph": "<p>([^<]*)"}

#: Equal patterns that Java matches in time linear in the text: a local part is tried only where its run of
#: characters (or what the last match left of it) begins, and never given back. Other engines lack these forms.
LINEAR = {FIELDS["email"]: "(?:\\G|(?<![A-Za-z0-9._+-]))[A-Za-z0-9._+-]++@[A-Za-z0-9-]++[.][A-Za-z0-9.]*[A-Za-z0-9]"}

#: A character that each match of a pattern holds; texts without it aren't searched.
NEEDED = {FIELDS["email"]: "@", FIELDS["phone"]: "+"}
