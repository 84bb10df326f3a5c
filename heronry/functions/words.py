"""Word lists, shortest words first."""

#: English function words, without contractions, which no token can equal.
STOPWORDS = tuple(
    """
a i am an as at be by do he if in is it me my no of on or so to up we all and any are but did few for had has her him
his how its nor not off our out own she the too was who why you been both does down each from have here hers into more
most once only ours over same some such than that them then they this very were what when whom with your about above
after again being below could doing other ought their there these those under until where which while would yours
before cannot during having itself myself should theirs against because between further herself himself through
yourself ourselves themselves yourselves
""".split()
)

#: The shorter list by which the routing signals judge a query.
SIGNAL_STOPWORDS = tuple(
    """
a i an at be if in is it of on or to we and are but for its the was you been that they this were with being these
those
""".split()
)

NEGATIONS = ("vs", "no", "nor", "not", "never", "except", "neither", "without")
QUESTION_WORDS = ("do", "is", "are", "can", "how", "who", "why", "does", "what", "when", "could", "where", "which", "would", "should")
