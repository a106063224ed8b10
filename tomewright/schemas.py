"""Explicit schemas of catalog records. Nothing is inferred: ratings mix whole and fractional numbers."""

from __future__ import annotations

SIGNAL = "struct<verdict:string,confidence:double,source:string,note:string>"
EVIDENCE = "struct<sourceUrl:string,additionalSourceUrls:array<string>,reviewedAt:string,taxonomyVersion:string>"
PROOF = "struct<documentId:string,url:string,observedAt:string,sourceType:string>"
TASTE = "map<string,struct<value:double,confidence:double>>"

BOOK = f"""ordinal bigint, id string, workId string, title string, subtitle string, series string, seriesKey string, seriesNumber double,
author string, narrator string, releaseDate string, coverUrl string, runtimeMinutes int, subgenres array<string>, description string, url string,
rating double, ratingCount int, edition string, scope string, contentType string, contentDeliveryType string,
content struct<sexualized:{SIGNAL},explicit:{SIGNAL},harem:{SIGNAL},aiNarration:{SIGNAL},aiWriting:{SIGNAL},quality:{SIGNAL}>,
assessment struct<model:string,evaluatedAt:string,inputHash:string,taste:{TASTE},genre:struct<value:string,confidence:double>,explicit:{SIGNAL},harem:{SIGNAL},quality:{SIGNAL}>,
features array<string>, featureEvidence {EVIDENCE}, sources array<struct<name:string,fetchedAt:string,url:string>>, issues array<string>"""

COVERED = "struct<workId:string,number:double,state:string,releaseDate:string,editionIds:array<string>>"
ISSUE = "struct<code:string,message:string,number:double,workId:string>"
COVERAGE = f"""struct<status:string,current:boolean,assessedAt:string,manifestId:string,scope:string,language:string,marketplaces:array<string>,
verifiedAt:string,validUntil:string,expectedNumbers:array<double>,releasedWorkIds:array<string>,scheduledWorkIds:array<string>,
works:array<{COVERED}>,sourceUrls:array<string>,issues:array<{ISSUE}>>"""
WORK = "struct<id:string,title:string,number:double,bookId:string,editionIds:array<string>,audioReleaseDate:string,verified:boolean,hasAudio:boolean>"
SERIES = f"""ordinal bigint, id string, title string, author string, aliases array<string>, description string, features array<string>,
featureEvidence {EVIDENCE}, genres array<string>, coverBookId string, works array<{WORK}>, curated boolean, status string,
audioCoverage {COVERAGE}, sourceUrls array<string>, updatedAt string"""

LIBRARY = "struct<version:int,series:map<string,struct<followedAt:string>>,books:map<string,struct<status:string,rating:double,updatedAt:string,work:struct<series:string,number:double>>>>"
MANIFEST = f"""id string, seriesId string, scope string, language string, marketplaces array<string>, expectedNumbers array<double>, reviewedAt string,
audioCatalogState string, bibliography array<{PROOF}>, finalListEvidence {PROOF}"""
COVERAGE_WORK = "id string, seriesId string, number double, role string"
COVERAGE_EDITION = f"""id string, workId string, format string, verification struct<method:string,evidence:{PROOF},workId:string,seriesId:string,
number:double,language:string,marketplace:string,format:string,audioReleaseDate:string>"""

SCORE = "struct<percent:double,earned:double,possible:double,explanation:string>"
CHECK = "struct<id:string,label:string,status:string,available:boolean,explanation:string,sourceUrl:string,observedAt:string,dueAt:string>"
PROBLEM = "struct<code:string,status:string,message:string>"
SOURCE = "struct<url:string,status:string,checkedAt:string,fetchedAt:string,nextCheckAt:string>"
HEALTH_SERIES = f"""id string, title string, author string, workIds array<string>, knownWorks int, confirmedAudioWorks int, completeness {SCORE}, evidenceQuality {SCORE},
checks array<{CHECK}>, issues array<{PROBLEM}>, missingVolumes array<struct<number:double,evidence:string,status:string,explanation:string,sourceUrls:array<string>>>, sources array<{SOURCE}>"""
HEALTH_WORK = f"""id string, seriesId string, number double, title string, author string, formats array<string>, completeness {SCORE}, evidenceQuality {SCORE},
checks array<{CHECK}>, issues array<{PROBLEM}>, audio struct<state:string,releaseDate:string>, sources array<{SOURCE}>"""
READER_CONTEXT = """struct<substantiveVoices:double,span:array<string>,sources:array<struct<name:string,url:string>>,consensus:string,observation:string,
impressions:array<string>,critiques:array<string>,traits:array<struct<trait:string,value:string,confidence:double,summary:string>>>"""

USERS = "id string, username string, display_name string, avatar_url string, created_at bigint, updated_at bigint, birth_date string, birth_attested_at string, allow_adult int"
SESSIONS = "token_hash string, user_id string, expires_at bigint"
STATES = "state_hash string, verifier string, return_to string, expires_at bigint"
LIBRARIES = "user_id string, library_json string, revision int, updated_at bigint"
