"""Measured log-probabilities of answers' first steps and the expected ratings
that follow from them.  They must stay as they are; results are checked against them."""

# alternatives of a first step, (token, log-probability), most likely first
V01_TOP = [("5", -1.1236724853515625), ("4", -1.2486724853515625), ("6", -1.8736724853515625),
           ("I", -1.9986724853515625), ("As", -2.8736724853515625)]
V02_TOP = [("4", -0.31899556517601013), ("5", -1.3189955949783325), ("3", -5.193995475769043),
           ("6", -8.693995475769043), ("2", -16.44399642944336)]
V08_TOP = [("40", -0.5899749398231506), ("50", -0.8399749398231506), ("45", -4.714974880218506),
           ("30", -5.464974880218506), ("60", -7.839974880218506)]
V09_TOP = [("4", -0.5790143609046936), ("5", -0.8290143609046936), ("3", -5.829014301300049),
           ("6", -8.954014778137207), ("４", -18.57901382446289)]
SINGLE = ("2", -0.5793678)  # a step with one alternative

# probability-weighted ratings of the steps above
V01_WEIGHTED = 4.825836887095913
V02_WEIGHTED = 4.262189001693707
V08_WEIGHTED = 44.32908363413877
V09_WEIGHTED = 4.433796753395972
