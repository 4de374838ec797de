"""Closed vocabularies of the catalog. Fixed values."""

CATEGORIES = ("Nonprofit", "Music", "Visual Art", "Film / Video", "Theater", "Dance", "Writing / Literature", "Photography", "Research", "Education", "Community Project", "Small Business", "Technology", "Agriculture / Food")
APPLICANT_TYPES = ("individual", "organization", "business", "nonprofit", "fiscal_sponsored", "collective", "student", "researcher", "consultant")
STATUSES = ("open", "upcoming", "between_rounds", "unknown", "unannounced", "round_ended", "closed", "discontinued")
STAGES = ("saved", "preparing", "submitted", "awarded", "declined", "withdrawn")
FACT_FIELDS = ("status", "deadline", "opens", "recurrence", "minimum", "maximum", "rolling", "categories", "eligibility", "applicants", "geography")

#: Population-focus tags and the words that name them; fixed values.
FOCUS = {
    "lgbtq": "lgbt[qia]*|queer|lesbian|gay|bisexual|transgender|nonbinary|non-binary|two-spirit",
    "women": "women|woman|female|womxn",
    "minorities": "minority|minorities|bipoc|people of colo[u]?r|persons of colo[u]?r|black|african[- ]american|hispanic|latino|latina|latinx|latine|indigenous|native american|american indian|alaska native|asian[- ]american|pacific islander|aapi",
    "veterans": "veterans?|military families|military spouses?|service members?|servicemembers?|active[- ]duty",
    "disabilities": "disabilit(?:y|ies)|disabled|deaf|hard of hearing|visually impaired|blindness|neurodiver(?:gent|sity)|autis(?:m|tic)",
    "indigenous": "indigenous|tribal|tribes?|native american|american indian|alaska native|native hawaiian|first nations",
    "immigrants": "immigrants?|refugees?|asylum[- ]seekers?|new americans|migrant (?:families|workers|communities)",
    "youth": "children|childhood|youth|teens?|teenagers?|adolescents?|young people|young adults?|foster care",
    "older-adults": "older adults?|older people|elderly|senior citizens?|aging populations?|ageing populations?|seniors",
    "rural": "rural|remote communities|small[- ]towns?",
    "low-income": "low[- ]income|lower[- ]income|poverty|economically disadvantaged|financial hardship|financial need|economically distressed",
}

#: The time at which the registered queries ask.
AS_OF = "2024-01-31 00:00:00"

#: States by their codes; fixed values.
STATES = tuple(
    tuple(pair.split(":"))
    for pair in (
        "AL:Alabama|AK:Alaska|AZ:Arizona|AR:Arkansas|CA:California|CO:Colorado|CT:Connecticut|DE:Delaware|DC:District of Columbia|FL:Florida|GA:Georgia|HI:Hawaii|ID:Idaho|IL:Illinois|IN:Indiana|IA:Iowa|KS:Kansas|KY:Kentucky|LA:Louisiana|ME:Maine|MD:Maryland|"
        "MA:Massachusetts|MI:Michigan|MN:Minnesota|MS:Mississippi|MO:Missouri|MT:Montana|NE:Nebraska|NV:Nevada|NH:New Hampshire|NJ:New Jersey|NM:New Mexico|NY:New York|NC:North Carolina|ND:North Dakota|OH:Ohio|OK:Oklahoma|OR:Oregon|PA:Pennsylvania|RI:Rhode Island|"
        "SC:South Carolina|SD:South Dakota|TN:Tennessee|TX:Texas|UT:Utah|VT:Vermont|VA:Virginia|WA:Washington|WV:West Virginia|WI:Wisconsin|WY:Wyoming|PR:Puerto Rico"
    ).split("|")
)
#: Countries that are known by name where a caller gives no list of its own.
COUNTRIES = ("Australia", "Brazil", "Canada", "China", "France", "Georgia", "Germany", "India", "Ireland", "Italy", "Japan", "Kenya", "Mexico", "Netherlands", "New Zealand", "Nigeria", "South Africa", "Spain", "Sweden", "Switzerland", "United Kingdom", "United States")
