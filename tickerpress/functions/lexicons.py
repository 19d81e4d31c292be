"""Default word lists and the constants of the valence rules."""

from __future__ import annotations

# Finance word lists by category.  A word may be in more than one
# list and counts in each.
POSITIVE = """
    achieve achieved achievement advance advancing advantage beat beats benefit beneficial better
    boom booming boost boosted breakthrough confident confidence efficient efficiency gain gains
    gained good great growth grow growing improve improved improvement improving innovative
    innovation opportunity opportunities optimistic optimism outperform profit profitable profits
    progress prosper prosperity rebound recovered recovery resilient resilience rise rising rose
    stable stability strength strong stronger strongest success successful surge surged upbeat
    upside
""".split()

NEGATIVE = """
    adverse adversely bad bankrupt bankruptcy bearish blow breach collapse collapsed concern
    concerns concerned concerning crash crisis critical cut cuts damage damaged decline declined
    declining default deficit depressed depressing deteriorate deteriorated disappoint disappointed
    disappointing dispute disruption disrupted doubt doubts downgrade downgraded down downside
    downturn drop dropped fail failed failing failure fall fallen falling fear fears feared fragile
    fraud friction grim halt halted hard harm harmful hit hurdle hurdles instability jitter jitters
    lag lagging layoff layoffs leak leaked liability liabilities loss losses lost miss missed
    missing negative notch penalty plunge plunged poor pressure pressured recession recessionary
    restructure restructuring risk risks risky shock shocked shortfall shrink shrinking slack slid
    slide sliding slip slipped slow slowed slowing slowdown slump slumped strain strained stress
    stressed struggle struggled struggling tension tensions threat threats turmoil turbulent
    uncertain uncertainty underperform unfavorable volatile volatility vulnerable warn warned
    warning warnings weak weaken weakened weakening weaker weakest worry worried worries worse
    worsen worsened worst
""".split()

UNCERTAINTY = """
    ambiguous appear appears approximately believe conceivable contingent could depend doubt either
    estimate estimated eventual fluctuate fluctuating if improbable indefinite likely may maybe
    might pending possible possibly probable probably question rough seem speculate uncertain
    uncertainty unclear unknown unpredictable unsure whether
""".split()

# Degree words and negations of the valence rules (Hutto & Gilbert 2014).
BOOSTERS = """
    absolutely amazingly awfully completely considerably decidedly deeply enormously entirely
    especially exceptionally extremely fabulously fully greatly hella highly hugely incredibly
    intensely majorly more most particularly purely quite really remarkably so substantially
    thoroughly totally tremendously uber unbelievably unusually utterly very
""".split()

DAMPENERS = """
    almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely
    slightly somewhat sorta sortof sort-of
""".split()

NEGATIONS = """
    aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt
    neither neednt never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh uh-uh wasnt
    werent without wont wouldnt rarely seldom despite
""".split()

# Weights of the valence rules.
BOOST = 0.293
CAPITALS = 0.733
NEGATION = -0.74
NORMALISER = 15.0
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
