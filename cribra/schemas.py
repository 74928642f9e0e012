"""Schemas: the study document, registry pages, table layouts and enums.

Every schema here is a plain ``StructType`` so that reads never infer types
(inference costs a full extra pass over the input at scale).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Study document sections: module name -> Spark DDL of the module struct.
# Field names and types of the public registry contract.
STUDY_MODULES = {
    'protocolSection': [
        ('identificationModule', 'struct<nctId:string,nctIdAliases:array<string>,orgStudyIdInfo:struct<id:string,type:string,link:string>,secondaryIdInfos:array<struct<id:string,type:string,domain:string,link:string>>,briefTitle:string,officialTitle:string,acronym:string,organization:struct<fullName:string,class:string>>'),
        ('statusModule', 'struct<statusVerifiedDate:string,overallStatus:string,lastKnownStatus:string,delayedPosting:boolean,whyStopped:string,expandedAccessInfo:struct<hasExpandedAccess:boolean,nctId:string,statusForNctId:string>,startDateStruct:struct<date:string,type:string>,primaryCompletionDateStruct:struct<date:string,type:string>,completionDateStruct:struct<date:string,type:string>,studyFirstSubmitDate:date,studyFirstSubmitQcDate:date,studyFirstPostDateStruct:struct<date:date,type:string>,resultsWaived:boolean,resultsFirstSubmitDate:date,resultsFirstSubmitQcDate:date,resultsFirstPostDateStruct:struct<date:date,type:string>,dispFirstSubmitDate:date,dispFirstSubmitQcDate:date,dispFirstPostDateStruct:struct<date:date,type:string>,lastUpdateSubmitDate:date,lastUpdatePostDateStruct:struct<date:date,type:string>>'),
        ('sponsorCollaboratorsModule', 'struct<responsibleParty:struct<type:string,investigatorFullName:string,investigatorTitle:string,investigatorAffiliation:string,oldNameTitle:string,oldOrganization:string>,leadSponsor:struct<name:string,class:string>,collaborators:array<struct<name:string,class:string>>>'),
        ('oversightModule', 'struct<oversightHasDmc:boolean,isFdaRegulatedDrug:boolean,isFdaRegulatedDevice:boolean,isUnapprovedDevice:boolean,isPpsd:boolean,isUsExport:boolean,fdaaa801Violation:boolean>'),
        ('descriptionModule', 'struct<briefSummary:string,detailedDescription:string>'),
        ('conditionsModule', 'struct<conditions:array<string>,keywords:array<string>>'),
        ('designModule', 'struct<studyType:string,nPtrsToThisExpAccNctId:bigint,expandedAccessTypes:struct<individual:boolean,intermediate:boolean,treatment:boolean>,patientRegistry:boolean,targetDuration:string,phases:array<string>,designInfo:struct<allocation:string,interventionModel:string,interventionModelDescription:string,primaryPurpose:string,observationalModel:string,timePerspective:string,maskingInfo:struct<masking:string,maskingDescription:string,whoMasked:array<string>>>,bioSpec:struct<retention:string,description:string>,enrollmentInfo:struct<count:bigint,type:string>>'),
        ('armsInterventionsModule', 'struct<armGroups:array<struct<label:string,type:string,description:string,interventionNames:array<string>>>,interventions:array<struct<type:string,name:string,description:string,armGroupLabels:array<string>,otherNames:array<string>>>>'),
        ('outcomesModule', 'struct<primaryOutcomes:array<struct<measure:string,description:string,timeFrame:string>>,secondaryOutcomes:array<struct<measure:string,description:string,timeFrame:string>>,otherOutcomes:array<struct<measure:string,description:string,timeFrame:string>>>'),
        ('eligibilityModule', 'struct<eligibilityCriteria:string,healthyVolunteers:boolean,sex:string,genderBased:boolean,genderDescription:string,minimumAge:string,maximumAge:string,stdAges:array<string>,studyPopulation:string,samplingMethod:string>'),
        ('contactsLocationsModule', 'struct<centralContacts:array<struct<name:string,role:string,phone:string,phoneExt:string,email:string>>,overallOfficials:array<struct<name:string,affiliation:string,role:string>>,locations:array<struct<facility:string,status:string,city:string,state:string,zip:string,country:string,contacts:array<struct<name:string,role:string,phone:string,phoneExt:string,email:string>>,geoPoint:struct<lat:double,lon:double>>>>'),
        ('referencesModule', 'struct<references:array<struct<pmid:string,type:string,citation:string,retractions:array<struct<pmid:string,source:string>>>>,seeAlsoLinks:array<struct<label:string,url:string>>,availIpds:array<struct<id:string,type:string,url:string,comment:string>>>'),
        ('ipdSharingStatementModule', 'struct<ipdSharing:string,description:string,infoTypes:array<string>,timeFrame:string,accessCriteria:string,url:string>'),
    ],
    'resultsSection': [
        ('participantFlowModule', 'struct<preAssignmentDetails:string,recruitmentDetails:string,typeUnitsAnalyzed:string,groups:array<struct<id:string,title:string,description:string>>,periods:array<struct<title:string,milestones:array<struct<type:string,comment:string,achievements:array<struct<groupId:string,comment:string,numSubjects:string,numUnits:string>>>>,dropWithdraws:array<struct<type:string,comment:string,reasons:array<struct<groupId:string,comment:string,numSubjects:string,numUnits:string>>>>>>>'),
        ('baselineCharacteristicsModule', 'struct<populationDescription:string,typeUnitsAnalyzed:string,groups:array<struct<id:string,title:string,description:string>>,denoms:array<struct<units:string,counts:array<struct<groupId:string,value:string>>>>,measures:array<struct<title:string,description:string,populationDescription:string,paramType:string,dispersionType:string,unitOfMeasure:string,calculatePct:boolean,denomUnitsSelected:string,denoms:array<struct<units:string,counts:array<struct<groupId:string,value:string>>>>,classes:array<struct<title:string,denoms:array<struct<units:string,counts:array<struct<groupId:string,value:string>>>>,categories:array<struct<title:string,measurements:array<struct<groupId:string,value:string,spread:string,lowerLimit:string,upperLimit:string,comment:string>>>>>>>>>'),
        ('outcomeMeasuresModule', 'struct<outcomeMeasures:array<struct<type:string,title:string,description:string,populationDescription:string,reportingStatus:string,anticipatedPostingDate:string,paramType:string,dispersionType:string,unitOfMeasure:string,calculatePct:boolean,timeFrame:string,typeUnitsAnalyzed:string,denomUnitsSelected:string,groups:array<struct<id:string,title:string,description:string>>,denoms:array<struct<units:string,counts:array<struct<groupId:string,value:string>>>>,classes:array<struct<title:string,denoms:array<struct<units:string,counts:array<struct<groupId:string,value:string>>>>,categories:array<struct<title:string,measurements:array<struct<groupId:string,value:string,spread:string,lowerLimit:string,upperLimit:string,comment:string>>>>>>,analyses:array<struct<paramType:string,paramValue:string,dispersionType:string,dispersionValue:string,statisticalMethod:string,statisticalComment:string,pValue:string,pValueComment:string,ciNumSides:string,ciPctValue:string,ciLowerLimit:string,ciUpperLimit:string,ciLowerLimitComment:string,ciUpperLimitComment:string,estimateComment:string,testedNonInferiority:boolean,nonInferiorityType:string,nonInferiorityComment:string,otherAnalysisDescription:string,groupDescription:string,groupIds:array<string>>>>>>'),
        ('adverseEventsModule', 'struct<frequencyThreshold:string,timeFrame:string,description:string,allCauseMortalityComment:string,eventGroups:array<struct<id:string,title:string,description:string,deathsNumAffected:bigint,deathsNumAtRisk:bigint,seriousNumAffected:bigint,seriousNumAtRisk:bigint,otherNumAffected:bigint,otherNumAtRisk:bigint>>,seriousEvents:array<struct<term:string,organSystem:string,sourceVocabulary:string,assessmentType:string,notes:string,stats:array<struct<groupId:string,numEvents:bigint,numAffected:bigint,numAtRisk:bigint>>>>,otherEvents:array<struct<term:string,organSystem:string,sourceVocabulary:string,assessmentType:string,notes:string,stats:array<struct<groupId:string,numEvents:bigint,numAffected:bigint,numAtRisk:bigint>>>>>'),
        ('moreInfoModule', 'struct<limitationsAndCaveats:struct<description:string>,certainAgreement:struct<piSponsorEmployee:boolean,restrictionType:string,restrictiveAgreement:boolean,otherDetails:string>,pointOfContact:struct<title:string,organization:string,email:string,phone:string,phoneExt:string>>'),
    ],
    'annotationSection': [
        ('annotationModule', 'struct<unpostedAnnotation:struct<unpostedResponsibleParty:string,unpostedEvents:array<struct<type:string,date:date,dateUnknown:boolean>>>,violationAnnotation:struct<violationEvents:array<struct<type:string,description:string,creationDate:date,issuedDate:date,releaseDate:date,postedDate:date>>>>'),
    ],
    'documentSection': [
        ('largeDocumentModule', 'struct<noSap:boolean,largeDocs:array<struct<typeAbbrev:string,hasProtocol:boolean,hasSap:boolean,hasIcf:boolean,label:string,date:date,uploadDate:string,filename:string,size:bigint>>>'),
    ],
    'derivedSection': [
        ('miscInfoModule', 'struct<versionHolder:date,removedCountries:array<string>,submissionTracking:struct<estimatedResultsFirstSubmitDate:date,firstMcpInfo:struct<postDateStruct:struct<date:date,type:string>>,submissionInfos:array<struct<releaseDate:date,unreleaseDate:date,unreleaseDateUnknown:boolean,resetDate:date,mcpReleaseN:bigint>>>>'),
        ('conditionBrowseModule', 'struct<meshes:array<struct<id:string,term:string>>,ancestors:array<struct<id:string,term:string>>,browseLeaves:array<struct<id:string,name:string,asFound:string,relevance:string>>,browseBranches:array<struct<abbrev:string,name:string>>>'),
        ('interventionBrowseModule', 'struct<meshes:array<struct<id:string,term:string>>,ancestors:array<struct<id:string,term:string>>,browseLeaves:array<struct<id:string,name:string,asFound:string,relevance:string>>,browseBranches:array<struct<abbrev:string,name:string>>>'),
    ],
    'hasResults': [
        ('hasResults', 'boolean'),
    ],
}


def _module_fields(section: str, date_as_string: bool) -> list[str]:
    parts = []
    for name, ddl in STUDY_MODULES[section]:
        if date_as_string:
            # Dates are read as written and parsed strictly later: a malformed
            # date must become NULL in one column, not poison the whole row.
            ddl = ddl.replace(":date,", ":string,").replace(":date>", ":string>")
        parts.append(f"{name}:{ddl}")
    return parts


def study_ddl(date_as_string: bool = True) -> str:
    """Spark DDL of one study document (six top-level fields)."""
    fields = []
    for section in ("protocolSection", "resultsSection", "annotationSection",
                    "documentSection", "derivedSection"):
        fields.append(f"{section}:struct<{','.join(_module_fields(section, date_as_string))}>")
    fields.append("hasResults:boolean")
    return "struct<" + ",".join(fields) + ">"


# DDL strings are accepted by ``spark.read.schema`` and ``from_json`` directly,
# so no JVM is needed to import this module.
STUDY_DDL = study_ddl()

# One registry page: the studies, the continuation token and the optional total.
PAGE_DDL = f"studies array<{STUDY_DDL}>, nextPageToken string, totalCount bigint"


def study_schema() -> T.DataType:
    """The study type as a Spark ``DataType`` (needs an active session)."""
    return T._parse_datatype_string(STUDY_DDL)  # type: ignore[attr-defined]

# Landing line of a Bronze batch: every column is text; casts happen on merge.
BRONZE_LANDING_SCHEMA = T.StructType([
    T.StructField("nct_id", T.StringType()),
    T.StructField("last_update_posted", T.StringType()),
    T.StructField("raw", T.StringType()),
])
# Arrival order of a landed line, where the writer knows it.
LANDING_ORDER = (T.StructField("page_file", T.StringType()), T.StructField("pos", T.LongType()))

# The four reference columns, plus what readers filter and read most, extracted
# once when the row is written: ``eligibility`` (every Silver step) and the
# scope fields, so that scans prune to them and filters reach parquet instead
# of re-parsing ``raw``.
BRONZE_SCHEMA = T.StructType([
    T.StructField("nct_id", T.StringType(), False),
    T.StructField("last_update_posted", T.DateType()),
    T.StructField("raw", T.StringType(), False),
    T.StructField("ingested_at", T.TimestampType(), False),
    T.StructField("eligibility", T.StringType()),
    T.StructField("overall_status", T.StringType()),
    T.StructField("study_type", T.StringType()),
    T.StructField("ancestors", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("term", T.StringType())]))),
])

RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("mode", T.StringType(), False),
    T.StructField("started_at", T.TimestampType(), False),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("studies_written", T.LongType()),
    T.StructField("watermark", T.DateType()),
    T.StructField("complete", T.BooleanType(), False),
])

SILVER_SCHEMA = T.StructType([
    T.StructField("nct_id", T.StringType(), False),
    T.StructField("signature", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("criterion_id", T.StringType()),
    T.StructField("text", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("is_exclusion", T.BooleanType(), False),
    T.StructField("extracted_at", T.TimestampType(), False),
])

# The silver landing line: the first seven columns, all text.
SILVER_LANDING_SCHEMA = T.StructType(
    [T.StructField(f.name, T.StringType()) for f in SILVER_SCHEMA.fields[:7]]
)

FAILURES_SCHEMA = T.StructType([
    T.StructField("nct_id", T.StringType(), False),
    T.StructField("signature", T.StringType(), False),
    T.StructField("error", T.StringType()),
    T.StructField("attempts", T.IntegerType(), False),
    T.StructField("last_failed_at", T.TimestampType(), False),
])

CRITERION_TYPE = T.StructType([
    T.StructField("criterion_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("is_exclusion", T.BooleanType()),
])

# One extraction outcome: ``error`` is set exactly when ``criteria`` is NULL.
OUTCOME_SCHEMA = T.StructType([
    T.StructField("nct_id", T.StringType()),
    T.StructField("criteria", T.ArrayType(CRITERION_TYPE)),
    T.StructField("error", T.StringType()),
])

# Append-only attempt log; Silver and the failure counters are views over it.
ATTEMPTS_SCHEMA = T.StructType([
    T.StructField("nct_id", T.StringType(), False),
    T.StructField("signature", T.StringType(), False),
    T.StructField("batch", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("criteria", T.ArrayType(CRITERION_TYPE)),
    T.StructField("error", T.StringType()),
    T.StructField("at", T.TimestampType(), False),
    T.StructField("run", T.StringType()),
])

# The twenty criterion kinds, in taxonomy order.
CRITERION_KINDS = (
    "condition", "stage", "biomarker", "comorbidity", "infection",
    "lab", "organ_function", "ecog", "age", "life_expectancy", "measurable_disease",
    "prior_therapy", "concurrent_therapy", "procedure", "washout", "allergy",
    "reproductive", "consent", "compliance", "other",
)

# Registry enums checked on read (the scope fields).
OVERALL_STATUS = (
    "ACTIVE_NOT_RECRUITING", "COMPLETED", "ENROLLING_BY_INVITATION", "NOT_YET_RECRUITING",
    "RECRUITING", "SUSPENDED", "TERMINATED", "WITHDRAWN", "AVAILABLE",
    "NO_LONGER_AVAILABLE", "TEMPORARILY_NOT_AVAILABLE", "APPROVED_FOR_MARKETING",
    "WITHHELD", "UNKNOWN",
)
STUDY_TYPE = ("EXPANDED_ACCESS", "INTERVENTIONAL", "OBSERVATIONAL")
PHASE = ("NA", "EARLY_PHASE1", "PHASE1", "PHASE2", "PHASE3", "PHASE4")
SEX = ("FEMALE", "MALE", "ALL")
STANDARD_AGE = ("CHILD", "ADULT", "OLDER_ADULT")

# Paths into the study document.
NCT_ID_PATH = "protocolSection.identificationModule.nctId"
LAST_UPDATE_PATH = "protocolSection.statusModule.lastUpdatePostDateStruct.date"
ELIGIBILITY_PATH = "protocolSection.eligibilityModule.eligibilityCriteria"
ELIGIBILITY_JSON_PATH = "$." + ELIGIBILITY_PATH
